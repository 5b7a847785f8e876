"""Drive a stream over what has landed so far, into a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter, StreamingQuery

from postsift.session import ensure_checkpoint_dir


#: Where state is kept: lists, maps and timers need the embedded store, which uploads its changes to the checkpoint.
STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as the block runs; a query keeps those it was started with."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    with settings(spark, STATEFUL):
        return writer.start()


def landed(
    spark: SparkSession, folder: str, schema, pattern: str = "*", files_per_batch: int | None = None, nested: bool = False
) -> DataFrame:
    """A stream of the parquet files of a folder, oldest first; with ``nested`` also of the folders in it."""
    reader: DataStreamReader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if nested:
        reader = reader.option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, then read the result table back.

    Each batch is written under its own number, so a repeated batch replaces
    itself. In complete mode only the last batch counts.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")

    def keep(batch: DataFrame, number: int) -> None:
        part = 0 if mode == "complete" else number
        batch.write.mode("overwrite").parquet(f"{out}/batch={part}")

    writer = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep))
    started(writer, spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")
