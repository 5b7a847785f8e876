"""What the operators of this folder share: reading, Arrow batches, scratch tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.session import scratch, stored  # noqa: F401

#: Rows in one Arrow batch: long texts come in batches that stay small.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows, so that memory follows texts and not row counts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def sliced(table: pa.Table, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=rows)


def components(edges: DataFrame, stop_rounds: int = 64) -> DataFrame:
    """Smallest id reachable by ``edges`` (a, b): rows (id, root) for every id that has an edge.

    Alternates two joins-free rewrites: every node sends its larger neighbours, then
    its smaller ones, to its smallest neighbour. Both keep the components, and a
    path shrinks to a star in a logarithmic number of rounds. Hot nodes (the centre
    of a large star) are aggregated by ``min`` before the shuffle and joined back,
    where adaptive execution may split them.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(stop_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        small = stored(small, "small-star")
        if small.exceptAll(now).isEmpty() and small.count() == now.count():
            return small.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
                small.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        now = small
    raise RuntimeError("components did not settle")
