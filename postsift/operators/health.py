"""Is a source still healthy? Counts over runs, and the look of one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.operators.hygiene import is_flagged
from postsift.operators.keyed import first_n_per_key


def on_domain(url: Column, domains) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    out = F.lit(False)
    for domain in domains:
        out = out | (host == domain) | host.endswith("." + domain)
    return out


def degraded_reasons(
    batch: DataFrame, portals: dict[str, tuple[str, ...]] | None = None, by: str = "site"
) -> DataFrame:
    """(source, reasons) for each source whose rows look broken."""
    known = fixed.PORTAL_DOMAINS if portals is None else portals
    off = F.lit(False)
    for site, domains in known.items():
        off = off | ((F.col(by) == site) & ~on_domain(tx.text_or_empty(F.col("url")), domains))
    stats = batch.groupBy(F.col(by).alias("source")).agg(
        F.count("*").alias("n"),
        F.count_if(F.btrim(tx.text_or_empty(F.col("company"))) != "").alias("named"),
        F.count_if(tx.text_or_empty(F.col("title")).rlike("<[a-zA-Z/]")).alias("tagged"),
        F.count_if(off).alias("off"),
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("named") == 0, F.concat(F.lit("no company on any of "), F.col("n").cast("string"), F.lit(" results"))),
            F.when(F.col("tagged") > 0, F.concat(F.lit("HTML tags in "), F.col("tagged").cast("string"), F.lit(" titles"))),
            F.when(F.col("off") > 0, F.concat(F.col("off").cast("string"), F.lit(" links off the portal"))),
        ),
        lambda r: r.isNotNull(),
    )
    return stats.select("source", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def record_history(log: DataFrame, keep: int = fixed.KEEP_RUNS) -> DataFrame:
    """The last counts per source; a run that failed is not a zero."""
    return first_n_per_key(log.filter("error IS NULL"), ["source"], [F.desc("run_id")], keep)


def silent_sources(history: DataFrame, ran: DataFrame) -> DataFrame:
    """Sources of this run with nothing for the last runs, but something before.

    ``history`` is at most the kept runs per source, so one group is small.
    """
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("run_id")))
    ranked = history.withColumn("rank", rank)
    recent, earlier = F.col("rank") <= fixed.ZERO_RUNS, F.col("rank") > fixed.ZERO_RUNS
    return (
        ranked.groupBy("source")
        .agg(
            F.max(F.when(recent, F.col("n"))).alias("recent"),
            F.max(F.when(earlier, F.col("n"))).alias("before"),
        )
        .filter("recent = 0 AND before > 0")
        .join(ran.select("source").distinct(), "source", "left_semi")
        .select("source")
        .orderBy("source")
    )


def rolling_health(log: DataFrame) -> DataFrame:
    """The silent rule run after run: (run_id, source, silent)."""
    order = Window.partitionBy("source").orderBy("run_id")
    recent = order.rowsBetween(-(fixed.ZERO_RUNS - 1), 0)
    before = order.rowsBetween(-(fixed.KEEP_RUNS - 1), -fixed.ZERO_RUNS)
    silent = (F.sum("n").over(recent) == 0) & (F.max("n").over(before) > 0)
    return log.filter("error IS NULL").select(
        "run_id", "source", F.coalesce(silent, F.lit(False)).alias("silent")
    )


def health_lines(silent: DataFrame, degraded: DataFrame) -> DataFrame:
    """One line per problem: silent sources first, then degraded ones, by name."""
    quiet = silent.select(
        F.lit(0).alias("part"), "source",
        F.concat(
            F.col("source"),
            F.lit(f" returned 0 jobs for {fixed.ZERO_RUNS} runs in a row. It returned jobs before, "
                  "so the source may be blocked or its parser may be broken."),
        ).alias("line"),
    )
    broken = degraded.select(
        F.lit(1).alias("part"), "source",
        F.concat(F.col("source"), F.lit(" output looks broken: "), F.array_join("reasons", "; "), F.lit(".")).alias("line"),
    )
    return quiet.unionByName(broken).orderBy("part", "source")


def guard_flags(rows: DataFrame, by: str = "site") -> DataFrame:
    return rows.groupBy(F.col(by).alias("source")).agg(F.count_if(is_flagged(F.col("guard"))).alias("flagged"))
