"""The daily run as a stream: dedup against history, score, record."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.operators import dedup
from postsift.session import cut_lineage
from postsift.sources import sinks
from postsift.sources.feeds import complete_seen


def run_batch(
    batch: DataFrame,
    root: str,
    version: str,
    today: dt.date,
    score: Callable[[DataFrame], DataFrame],
    lookback: int = fixed.LOOKBACK_DAYS,
    retries: int = fixed.ERROR_RETRIES,
) -> DataFrame | None:
    """Filter one batch, score what is new, record it. Returns the scored rows.

    A version that was already recorded is left alone, so a batch delivered
    again after a lost executor or driver changes nothing.
    """
    spark = batch.sparkSession
    if sinks.current_version(spark, root) == sinks.version_path(root, version):
        return None
    history = sinks.read_history(spark, root)
    if history is None:
        history = complete_seen(spark.createDataFrame([], "job_id string"))
    outcome = dedup.filter_new(dedup.dedup_cross_source(batch), history, today, lookback, retries)
    # The scorer is called once per row: its answers are written before use.
    scored = cut_lineage(score(outcome.filter("outcome = 'new'").drop("outcome")))
    sinks.write_seen(scored, root, today, version)
    return scored


def version_of(batch: int) -> str:
    """The history version that a batch of the stream is recorded as."""
    return f"v{batch:08d}"


def incremental_dedup(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
    today: Callable[[int], dt.date],
    **limits: int,
) -> None:
    """Run every batch that has landed through :func:`run_batch`."""

    def on_batch(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            run_batch(batch, root, version_of(number), today(number), score, **limits)

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(on_batch)
        .start()
    )
    query.awaitTermination()


def unscored(rows: DataFrame) -> DataFrame:
    """A scorer that scores nothing: every row is new with no score."""
    return rows.withColumns({
        "status": F.lit("new"), "score": F.lit(None).cast("double"), "verdict_json": F.lit(""),
    })


def history_at(spark: SparkSession, root: str) -> DataFrame | None:
    return sinks.read_history(spark, root)
