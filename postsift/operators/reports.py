"""Reports over the history table and over application records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.operators.keyed import first_n_per_key, in_list
from postsift.schema import VERDICT

SCORED = "status = 'new' AND score IS NOT NULL"


def totals(history: DataFrame, threshold: float = 65) -> DataFrame:
    new = F.col("status") == "new"
    return history.agg(
        F.count("*").alias("total"),
        F.count_if(new & F.col("score").isNotNull()).alias("scored"),
        F.count_if(new & (F.col("score") >= threshold)).alias("cleared"),
    )


def status_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def score_band(score: Column) -> Column:
    out = F.lit("under 40")
    for low, label in ((40, "40 to 49"), (50, "50 to 59"), (60, "60 to 69"), (70, "70 to 79"), (80, "80 to 100")):
        out = F.when(score >= low, F.lit(label)).otherwise(out)
    return out


def score_histogram(history: DataFrame) -> DataFrame:
    banded = history.filter(SCORED).groupBy(score_band(F.col("score")).alias("band"))
    return banded.agg(F.count("*").alias("n")).orderBy(F.col("band") == "under 40", F.desc("band"))


def daily_scored(history: DataFrame, today: dt.date, days: int = 14, threshold: float = 65) -> DataFrame:
    """Per day: scored, best, and whether nothing reached the threshold."""
    since = today - dt.timedelta(days=days)
    recent = history.filter(SCORED).filter(F.col("first_seen") >= F.lit(since))
    return (
        recent.groupBy("first_seen")
        .agg(F.count("*").alias("n"), F.max("score").alias("best"))
        .withColumn("nothing_cleared", F.col("best") < threshold)
        .orderBy("first_seen")
    )


def top_scores(history: DataFrame, n: int = 8) -> DataFrame:
    best = history.filter(SCORED).orderBy(F.desc("score"), "job_id").limit(n)
    return best.select("job_id", "score", "title", "company", "first_seen")


def with_bars(counts: DataFrame, width: int = 34) -> DataFrame:
    """A text bar per row of a small count table, at least one mark when n > 0."""
    largest = counts.agg(F.max("n")).scalar()
    marks = F.greatest(F.lit(1), F.bround(F.lit(width) * F.col("n") / largest, 0).cast("int"))
    return counts.withColumn("bar", F.when(F.col("n") > 0, F.repeat(F.lit("#"), marks)).otherwise(""))


def window_range(today: dt.date, days: int) -> tuple[dt.date, dt.date]:
    """The inclusive range; ``days`` counts today."""
    return today - dt.timedelta(days=max(1, days) - 1), today


def window_bounds(days: DataFrame, today: str = "today", length: str = "days") -> DataFrame:
    """:func:`window_range` over columns."""
    back = F.greatest(F.lit(1), F.col(length)) - 1
    return days.withColumns({"first": F.date_sub(today, back.cast("int")), "last": F.col(today)})


def roundup(
    history: DataFrame, today: dt.date, days: int = 7, threshold: float = 65, top: int = 10
) -> DataFrame:
    """The best postings of the window, with ``total`` counted before the cut."""
    first, last = window_range(today, days)
    hits = history.filter(
        (F.col("status") == "new")
        & (F.col("score") >= threshold)
        & F.col("first_seen").between(F.lit(first), F.lit(last))
    )
    total = hits.agg(F.count("*")).scalar()
    best = hits.orderBy(F.desc("score"), "company", "job_id").limit(max(1, top))
    return best.select(
        "job_id",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("?")).alias("title"),
        F.coalesce(F.nullif("company", F.lit("")), F.lit("?")).alias("company"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("site", F.lit("")).alias("site"),
        F.bround("score", 0).cast("int").alias("score"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.from_json("verdict_json", VERDICT).alias("verdict"),
        total.alias("total"),
    )


def run_stats(outcomes: DataFrame, scored: DataFrame, threshold: int) -> DataFrame:
    """fetched, new, rejected and matched of one run, as one row."""
    hit = (F.col("status") == "new") & (F.col("score").cast("int") >= threshold)
    new = F.count_if(F.col("outcome") == "new")
    rejected = scored.agg(F.count_if(~F.coalesce(hit, F.lit(False)))).scalar()
    return outcomes.agg(F.count("*").alias("fetched"), new.alias("new")).select(
        "fetched", "new", rejected.alias("rejected"),
        F.greatest(F.lit(0), F.col("new") - rejected).alias("matched"),
    )


def rate_limited(message: Column) -> Column:
    lowered = F.lower(message)
    return lowered.contains("429") | lowered.contains("rate limit") | lowered.contains("too many requests")


def source_summary(report: DataFrame, by: str | None = None) -> DataFrame:
    """One line per run: counts, then errors, then degraded sources, each by name.

    ``report`` has (source, n, error, degraded) per run.
    """
    states = F.array(
        F.when(F.col("n").isNotNull() & F.col("error").isNull(), F.struct(
            F.lit(0).alias("part"), F.col("source").alias("name"),
            F.concat_ws(": ", "label", F.col("n").cast("string")).alias("text"))),
        F.when(F.col("error").isNotNull(), F.struct(
            F.lit(1).alias("part"), F.col("source").alias("name"),
            F.concat(F.col("label"), F.when(rate_limited(F.col("error")), ": rate-limited").otherwise(": FAILED")).alias("text"))),
        F.when(F.col("degraded"), F.struct(
            F.lit(2).alias("part"), F.col("source").alias("name"),
            F.concat(F.col("label"), F.lit(": DEGRADED")).alias("text"))),
    )
    keys = [by] if by else []
    rows = report.select(*keys, F.explode(F.filter(states, lambda s: s.isNotNull())).alias("s"))
    # As many entries as there are configured sources: small by construction.
    listed = F.array_sort(F.collect_list("s"))
    text = F.array_join(F.transform(listed, lambda s: s["text"]), " | ")
    return rows.groupBy(*keys).agg(
        F.when(F.count("*") == 0, "no sources ran").otherwise(text).alias("summary")
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("class").agg(F.count("*").alias("n")).orderBy("class")


# The three groups of the track record, in listing order.
_RECORD_GROUPS = (
    ("Converted", ("interviewing", "offer")),
    ("Applied and did not convert", ("rejected", "no_response")),
    ("Read and chose not to apply", ("withdrawn",)),
)


def context_block(outcomes: DataFrame, order: str, max_listed: int = 25) -> DataFrame:
    """The track record as one text, at most ``max_listed`` outcomes named.

    Only the listed rows are gathered; everything else is counts.
    """
    group = F.lit(None).cast("int")
    name = F.lit(None).cast("string")
    for number, (label, classes) in enumerate(_RECORD_GROUPS):
        mine = F.col("class").isin(*classes)
        group = F.when(mine, number).otherwise(group)
        name = F.when(mine, label).otherwise(name)
    rows = outcomes.withColumns({"grp": group, "grp_name": name})
    counts = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("grp") == 0).alias("positive"),
        F.count_if(F.col("grp").isNotNull()).alias("listable"),
    )
    label = F.concat_ws(" at ", F.nullif("title", F.lit("")), F.nullif("company", F.lit("")))
    listed = (
        rows.filter("grp IS NOT NULL")
        .orderBy("grp", order)
        .limit(max_listed + 1)
        .select("grp", "grp_name", order, F.concat(F.lit('  - "'), label, F.lit('" -> '), F.col("status")).alias("line"))
    )
    gathered = F.array_sort(F.collect_list(F.struct("grp", order, "grp_name", "line")))
    rest = counts.select("listable").scalar() - max_listed
    more = F.concat(F.lit("  - (+"), rest.cast("string"), F.lit(" more)"))
    # A heading goes above the first line of its group.
    lines = F.transform(
        F.col("items"),
        lambda x, i: F.concat(
            F.when(
                (i == 0) | (F.get(F.col("items"), i - 1)["grp"] != x["grp"]),
                F.concat(x["grp_name"], F.lit(":\n")),
            ).otherwise(""),
            F.when(i < max_listed, x["line"]).otherwise(F.col("more")),
        ),
    )
    head = F.concat(
        counts.select("rows").scalar().cast("string"),
        F.lit(" applications with a recorded outcome; "),
        counts.select("positive").scalar().cast("string"),
        F.lit(" reached interview or offer."),
    )
    return listed.agg(gathered.alias("items")).withColumn("more", more).select(
        F.when(counts.select("rows").scalar() == 0, "")
        .otherwise(F.concat_ws("\n", head, F.nullif(F.array_join(lines, "\n"), F.lit(""))))
        .alias("block")
    )


# --- application records ------------------------------------------------------------------


def funnel(records: DataFrame) -> DataFrame:
    """Counts by class in fixed order; classes without a row are left out."""
    place = F.array_position(F.array(*[F.lit(c) for c in fixed.FUNNEL_ORDER]), F.col("class"))
    counts = records.groupBy("class").agg(F.count("*").alias("n")).withColumn("place", place)
    return counts.filter("place > 0").orderBy("place").select("place", "class", "n")


def funnel_totals(records: DataFrame) -> DataFrame:
    """sent, leaked, and whether enough were sent to state a rate."""
    return records.agg(
        F.count("*").alias("records"),
        F.count_if(in_list(F.col("class"), fixed.SENT_CLASSES)).alias("sent"),
        F.count_if(F.col("class").isin("unrecorded", "other")).alias("leaked"),
    ).withColumn("rates_stated", F.col("sent") >= fixed.MIN_SENT)


def stale(records: DataFrame, today: dt.date, days: int = fixed.STALE_DAYS) -> DataFrame:
    """Tailored, undecided and not moved for ``days``; oldest first."""
    age = F.datediff(F.lit(today), F.col("date"))
    open_rows = records.filter(F.col("class").isin("other", "unrecorded") & F.col("has_cv"))
    return (
        open_rows.withColumn("age", age).filter(F.col("age") >= days)
        .select("age", "folder", F.coalesce(F.nullif("status", F.lit("")), F.lit("no status line")).alias("status"))
        .orderBy(F.desc("age"), "folder")
    )


def _nudged(records: DataFrame, today: dt.date, days: int) -> DataFrame:
    age = F.coalesce(F.datediff(F.lit(today), F.col("date")), F.lit(0))
    label = F.substring(
        F.concat_ws(" - ", F.nullif("company", F.lit("")), F.nullif("role", F.lit(""))), 1, 70
    )
    rows = records.filter("has_cv").withColumns({
        "age": age,
        "label": F.coalesce(F.nullif(label, F.lit("")), F.col("folder")),
    })
    late = (F.col("class") == "other") & F.col("date").isNotNull() & (F.col("age") >= days)
    return rows.filter((F.col("class") == "unrecorded") | late)


def nudge_lists(records: DataFrame, today: dt.date, days: int = fixed.STALE_DAYS) -> DataFrame:
    """The oldest few of both lists, each with how many more there are."""
    rows = _nudged(records, today, days)
    shown = first_n_per_key(rows, ["class"], [F.desc("age"), F.col("folder")], fixed.NUDGE_LISTED)
    counts = rows.groupBy("class").agg(F.count("*").alias("listed"))
    return shown.join(counts, "class").select(
        F.col("class").alias("list"), "age", "folder", "label",
        F.greatest(F.col("listed") - fixed.NUDGE_LISTED, F.lit(0)).alias("hidden"),
    )


def nudge_shortfall(records: DataFrame) -> DataFrame:
    sent = F.count_if(in_list(F.col("class"), fixed.SENT_CLASSES))
    return records.agg(sent.alias("sent")).withColumn(
        "short", F.greatest(F.lit(fixed.MIN_SENT) - F.col("sent"), F.lit(0))
    )


def silent_records(applications: DataFrame) -> DataFrame:
    """Applications the record cannot use, with the reason."""
    problem = F.when(F.col("notes").isNull(), "no notes").when(
        F.coalesce("status", F.lit("")) == "", "no status line"
    )
    return applications.withColumn("problem", problem).filter("problem IS NOT NULL").select("folder", "problem")
