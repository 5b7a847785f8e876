"""Small relational helpers the other operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key.

    Written as a ranked filter so that Spark trims each key inside the map tasks
    before the shuffle: a key holding a third of all rows ships ``n`` rows per
    task, not the whole group.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def anti_on_key(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Drop rows whose non-empty ``key`` is in ``known``.

    Rows with an empty key can never match and skip the join, so they do not
    pile up in one shuffle partition.
    """
    keyed = df.filter(F.col(key) != "")
    keyless = df.filter(F.coalesce(F.col(key), F.lit("")) == "")
    return keyed.join(known.select(key).distinct(), key, "left_anti").select(df.columns).unionByName(keyless)


def in_list(col: Column, values) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), col)
