"""Texts and rows for the sinks: digests, headers, message chunks, alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.operators.reports import window_range
from postsift.operators.rules import score_label
from postsift.operators.sensitive import redact


def csv_rows(scored: DataFrame, run_at: str) -> DataFrame:
    """The fixed columns of the CSV sink, lists joined with ``; ``."""
    v = F.col("verdict")
    made = {
        "run_at": F.lit(run_at),
        "score": F.coalesce(F.col("score"), F.lit(0)),
        "key_matches": F.coalesce(F.array_join(v["key_matches"], "; "), F.lit("")),
        "gaps": F.coalesce(F.array_join(v["gaps"], "; "), F.lit("")),
        "reasoning": tx.text_or_empty(v["reasoning"]),
    }
    return scored.select(
        *[(made[c] if c in made else tx.text_or_empty(F.col(c))).alias(c) for c in fixed.CSV_COLUMNS]
    )


def json_rows(scored: DataFrame, run_at: str) -> DataFrame:
    """Every column but the description, plus ``run_at``, as one JSON line each."""
    kept = [c for c in scored.columns if c != "description"]
    return scored.select(F.to_json(F.struct(*kept, F.lit(run_at).alias("run_at"))).alias("value"))


def _given(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def _joined(col: Column, glue: str, most: int) -> Column:
    return F.coalesce(F.array_join(F.slice(col, 1, most), glue), F.lit(""))


def job_lines(strong: int = 80, possible: int = 65) -> Column:
    """One posting as plain text; lines without content are left out."""
    v = F.col("verdict")
    score = F.coalesce(F.col("score").cast("int"), F.lit(0))
    site = F.upper(tx.text_or_empty(F.col("site")))
    place = tx.text_or_empty(F.col("location"))
    where = F.concat_ws(" ", F.nullif(place, F.lit("")), F.when(site != "", F.concat(F.lit("["), site, F.lit("]"))))
    matches, gaps = _joined(v["key_matches"], " | ", 3), _joined(v["gaps"], " | ", 2)
    why = F.btrim(tx.text_or_empty(v["reasoning"]))
    lines = [
        F.concat(
            F.lit("["), score_label(score, strong, possible), F.lit("] "), score.cast("string"), F.lit("% "),
            F.coalesce(F.col("title"), F.lit("?")),
        ),
        F.concat(F.lit("Company:  "), F.coalesce(F.col("company"), F.lit("?"))),
        F.when(where != "", F.concat(F.lit("Location: "), where)),
        F.when(_given(F.col("salary")), F.concat(F.lit("Salary:   "), F.col("salary"))),
        F.when(matches != "", F.concat(F.lit("Matches:  "), matches)),
        F.when(gaps != "", F.concat(F.lit("Gaps:     "), gaps)),
        F.when(why != "", F.concat(F.lit("Why:      "), why)),
        F.when(_given(F.col("url")), F.concat(F.lit("Link:     "), F.col("url"))),
    ]
    return F.concat_ws("\n", *lines)


def markdown_entry() -> Column:
    """One posting in the markdown digest."""
    v = F.col("verdict")
    matches, gaps = _joined(v["key_matches"], ", ", 3), _joined(v["gaps"], ", ", 2)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.coalesce(F.col("score"), F.lit(0)).cast("int").cast("string"), F.lit("% "),
                 F.coalesce(F.col("title"), F.lit("?"))),
        F.concat(F.lit("**"), F.coalesce(F.col("company"), F.lit("?")), F.lit("**. "),
                 tx.text_or_empty(F.col("location")), F.lit(" ("), tx.text_or_empty(F.col("site")), F.lit(")")),
        F.when(_given(F.col("salary")), F.concat(F.lit("Salary: "), F.col("salary"))),
        F.when(matches != "", F.concat(F.lit("Matches: "), matches)),
        F.when(gaps != "", F.concat(F.lit("Gaps: "), gaps)),
        F.when(_given(v["reasoning"]), F.concat(F.lit("Why: "), v["reasoning"])),
        F.when(_given(F.col("url")), F.concat(F.lit("<"), F.col("url"), F.lit(">"))),
        F.lit(""),
    )


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many))


def digest_header(stats: DataFrame, today: dt.date, threshold: int, name: str = "Postings") -> DataFrame:
    """Title and counts line of one run; ``stats`` as from ``run_stats``."""
    counts = F.concat(
        _plural(F.col("matched"), " match", " matches"), F.lit(" | "), F.col("new").cast("string"), F.lit(" new | "),
        F.col("rejected").cast("string"), F.lit(f" below {threshold} | "), F.col("fetched").cast("string"), F.lit(" fetched"),
    )
    return stats.withColumn("header", F.concat(F.lit(f"{name}, {today:%d %b %Y}\n"), counts))


def no_match_body(threshold: int, sources: Column, empty: Column | None = None) -> Column:
    """Nothing fetched, nothing new and nothing good enough are different news."""
    shown = tx.text_or_empty(sources)
    custom = tx.text_or_empty(empty) if empty is not None else F.lit("")
    return (
        F.when(custom != "", custom)
        .when(F.col("fetched") == 0, F.concat(
            F.lit("Every source returned 0 jobs.\nThat normally means a source is blocked or misconfigured "
                  "rather than that the market is quiet.\nSources: "),
            F.coalesce(F.nullif(shown, F.lit("")), F.lit("none ran")),
        ))
        .when(F.col("new") == 0, F.concat(
            F.lit("No new postings today.\nFetched "), F.col("fetched").cast("string"),
            F.lit(", all of them already seen.\nSources: "), shown,
        ))
        .otherwise(F.concat(
            F.lit(f"No matches at or above {threshold}.\nScanned "), F.col("new").cast("string"), F.lit(" new | "),
            F.col("rejected").cast("string"), F.lit(" below threshold | "), F.col("fetched").cast("string"),
            F.lit(" fetched.\nSources: "), shown,
        ))
    )


def roundup_header(roundup: DataFrame, today: dt.date, days: int, threshold: int, name: str = "Postings") -> DataFrame:
    """Span, and ``best x of y matches`` when the cut left some out."""
    first, last = window_range(today, days)
    counts = roundup.agg(F.count("*").alias("shown"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    counted = F.when(
        F.col("total") > F.col("shown"),
        F.concat(F.lit("best "), F.col("shown").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" matches")),
    ).otherwise(_plural(F.col("shown"), " match", " matches"))
    return counts.select(
        F.lit(f"{name} roundup, {first:%d %b} to {last:%d %b %Y}").alias("title"),
        F.concat(counted, F.lit(f" at or above {threshold}")).alias("subtitle"),
    )


def chunk_message(messages: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, chunk, body): lines packed greedily, no chunk over ``limit`` unless
    a single line is. Line ends stay with their lines."""
    lines = F.regexp_extract_all(F.col(text), F.lit(r"(?s)[^\n]*\n|[^\n]+$"), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def pack(state: Column, line: Column) -> Column:
        full = (F.length(state["open"]) + F.length(line) > limit) & (state["open"] != "")
        return F.struct(
            F.when(full, line).otherwise(F.concat(state["open"], line)).alias("open"),
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
        )

    packed = F.aggregate(lines, start, pack, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    chunks = F.when(F.length(text) <= limit, F.array(F.col(text))).otherwise(packed)
    return messages.select(key, F.posexplode(chunks).alias("chunk", "body"))


def alert_text(body: Column, today: dt.date, name: str = "Postings") -> Column:
    return F.concat(F.lit(f"{name} ALERT, {today:%d %b %Y}\n\n"), redact(body))


def note_text(body: Column, today: dt.date, name: str = "Postings") -> Column:
    return F.concat(F.lit(f"{name}, {today:%d %b %Y}\n\n"), redact(body))
