"""The flows: one day's postings from feeds to digest, as one chain."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.operators import dedup, hygiene, rules, scoring
from postsift.schema import Rules, VERDICT



def day_funnel(rows: DataFrame, keywords, ruleset: Rules) -> DataFrame:
    """Clean, merge the boards, apply the rules: where did the day's rows go?"""
    cleaned = hygiene.guard(rows)
    merged = dedup.dedup_cross_source(cleaned)
    routed = rules.route_status(merged, keywords, ruleset)
    return (
        routed.groupBy("guard", F.coalesce("status", F.lit("to_score")).alias("status"))
        .agg(F.count("*").alias("n"))
        .orderBy("guard", "status")
    )


def daily_run(
    rows: DataFrame,
    history: DataFrame,
    today: dt.date,
    keywords,
    ruleset: Rules,
    prompt,
    scorer: Callable[[str], str],
    limit: int | None = None,
    retries: int = 1,
    wait: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(every row with its dedup outcome, the new rows with status and score).

    Two points are written out: the outcomes, because the filter runs several
    jobs, and the scorer's answers, so that it is never called twice for a row.
    """
    outcomes = dedup.filter_new(dedup.dedup_cross_source(hygiene.guard(rows)), history, today)
    new = outcomes.filter("outcome = 'new'").drop("outcome")
    if limit:
        new = rules.limit_new(new, limit)
    routed = rules.route_status(new, keywords, ruleset)
    asked = routed.filter("status IS NULL").withColumn("prompt", prompt)
    answers = scoring.score_with(asked, "pos", scorer, retries, wait)
    judged = scoring.derive_status(
        asked.drop("status", "score", "prompt").join(answers.select("pos", "verdict_json"), "pos")
        .withColumn("verdict", scoring.read_verdict(F.col("verdict_json")))
    )
    rejected = routed.filter("status IS NOT NULL").withColumns({
        "verdict_json": F.lit(""), "verdict": F.lit(None).cast(VERDICT),
    })
    return outcomes, judged.unionByName(rejected)
