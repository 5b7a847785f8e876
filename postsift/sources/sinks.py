"""Where results are written. Every sink is a plain Spark writer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.operators import dedup, digest
from postsift.session import cut_lineage
from postsift.sources.feeds import complete_seen


def write_csv(scored: DataFrame, path: str, run_at: str, append: bool = True) -> None:
    """CSV files of one folder, each with the header line."""
    writer = digest.csv_rows(scored, run_at).write.mode("append" if append else "overwrite")
    writer.option("header", "true").option("escape", '"').csv(path)


def write_jsonl(scored: DataFrame, path: str, run_at: str, append: bool = True) -> None:
    digest.json_rows(scored, run_at).write.mode("append" if append else "overwrite").text(path)


def write_digest(scored: DataFrame, path: str, markdown: bool = True) -> None:
    """The digest entries in order, one text file part per range of scores."""
    entry = digest.markdown_entry() if markdown else F.concat(digest.job_lines(), F.lit("\n"))
    ordered = scored.orderBy(F.desc("score"), "pos").select(entry.alias("value"))
    ordered.write.mode("overwrite").text(path)


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(line, text): the lines of a digest in order, numbered from 1.

    The parts are ranges of the order, so their numbers are in the order of their names. A part is read as one value; what the
    parts before it hold is added from a table with one row for each part.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), "value").filter("value != ''")
    lines = files.select("part", F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1).alias("lines"))
    sizes = lines.select("part", F.size("lines").cast("long").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return lines.join(before, "part").select("before", F.posexplode("lines").alias("i", "text")).select(
        (F.col("before") + F.col("i") + 1).alias("line"), "text")


# --- the history ----------------------------------------------------------------------------
#
# root/CURRENT              the name of the version that readers use
# root/manifest/<version>   the version before it, then which version holds each day: "day<tab>version"
# root/data/v=<version>/first_seen=<day>/   the rows of that day


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then put it there in one step."""
    hadoop, gateway = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    target, fs = _hadoop(spark, path)
    ready = hadoop.Path(f"{path}.next")
    out = fs.create(ready, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    replace = gateway.new_array(hadoop.Options.Rename, 1)
    replace[0] = hadoop.Options.Rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(ready), fs.makeQualified(target), replace)


def _read_lines(spark: SparkSession, path: str) -> list[str]:
    where, fs = _hadoop(spark, path)
    return [r[0] for r in spark.read.text(where.toString()).collect()] if fs.exists(where) else []


def version_path(root: str, version: str) -> str:
    return f"{root}/manifest/{version}"


def current_version(spark: SparkSession, root: str) -> str | None:
    """The manifest of the history version that readers should use."""
    named = _read_lines(spark, f"{root}/CURRENT")
    return version_path(root, named[0]) if named else None


def _manifest(spark: SparkSession, path: str | None) -> tuple[str | None, dict[str, str]]:
    """The manifest before this one, and the version that holds each day."""
    lines = _read_lines(spark, path) if path else []
    return (lines[0] or None, dict(line.split("\t") for line in lines[1:])) if lines else (None, {})


def _day_path(root: str, day: str, version: str) -> str:
    return f"{root}/data/v={version}/first_seen={day}"


def read_history(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version; columns added since a day was written come out with their defaults."""
    _, days = _manifest(spark, current_version(spark, root))
    if not days:
        return None
    paths = [_day_path(root, day, version) for day, version in sorted(days.items())]
    rows = spark.read.option("basePath", f"{root}/data").option("mergeSchema", "true").parquet(*paths)
    return complete_seen(rows)


def store_days(rows: DataFrame, root: str, version: str) -> None:
    """Write the days in ``rows`` as ``version``; the other days stay where they are.

    Days are split into files by size. Readers see the version once all of it is there. What the version before the
    last one alone needed is removed.
    """
    spark = rows.sparkSession
    rows.hint("rebalance", "first_seen").write.mode("overwrite").partitionBy("first_seen").parquet(f"{root}/data/v={version}")
    before = current_version(spark, root)
    oldest, kept = _manifest(spark, before)
    where, fs = _hadoop(spark, f"{root}/data/v={version}")
    found = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(where) if s.isDirectory()]
    days = {**kept, **{day: version for day in found}}
    _put_text(spark, version_path(root, version), "\n".join([before or "", *(f"{d}\t{v}" for d, v in sorted(days.items()))]))
    _put_text(spark, f"{root}/CURRENT", version)
    for day, old in _manifest(spark, oldest)[1].items():
        if old not in (kept.get(day), days.get(day)):
            path, fs = _hadoop(spark, _day_path(root, day, old))
            fs.delete(path, True)


def write_seen(scored: DataFrame, root: str, today: dt.date, version: str) -> str:
    """Record a batch as the next version of the history.

    Only today's rows and the days that hold a scoring error of this batch are read in full and written again; of
    the rest of the history only ids are read. A failed job changes nothing, and the same ``version`` written twice
    is the same. One writer at a time.
    """
    spark = scored.sparkSession
    if current_version(spark, root) == version_path(root, version):
        return version
    history = read_history(spark, root)
    if history is None:
        store_days(dedup.upsert_seen(scored, complete_seen(spark.createDataFrame([], "job_id string")), today), root, version)
        return version
    batch = scored.withColumn("job_id", tx.job_id(F.col("url")))
    met = cut_lineage(
        history.select("job_id", "first_seen", "status").join(batch.select("job_id").distinct(), "job_id", "left_semi"))
    error = F.coalesce(F.col("status") == "scoring_error", F.lit(False))
    days = [r.first_seen for r in met.filter(error).select("first_seen").distinct().collect()]
    rest = batch.join(met.filter(~error).select("job_id").distinct(), "job_id", "left_anti")
    touched = F.col("first_seen").isin([today, *(day for day in days if day is not None)])
    if None in days:
        touched = touched | F.col("first_seen").isNull()
    store_days(dedup.upsert_seen(rest, history.filter(touched), today), root, version)
    return version


def outcomes_writable(spark: SparkSession, path: str) -> bool:
    """True unless a file kept by hand (another header) is already there."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return True
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].strip():
        return True
    header = tuple(c.strip().strip('"').lower() for c in first[0][0].lstrip("﻿").split(","))
    return header == fixed.OUTCOME_COLUMNS


def write_outcomes(rows: DataFrame, path: str) -> bool:
    """The four-column CSV; a file kept by hand is left alone (returns False)."""
    if not outcomes_writable(rows.sparkSession, path):
        return False
    rows.select(*fixed.OUTCOME_COLUMNS).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return True
