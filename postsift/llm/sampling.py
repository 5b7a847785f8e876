"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 40


def picked_rows(rows: DataFrame, id_col: str, by: str, per_value: int) -> DataFrame:
    """At most ``per_value`` ids for each value of ``by``, lowest hash of the id first: columns id, by.

    The values are counted first and thinned by hash to about four times what is wanted, so the ranking sees a bounded
    number of rows whatever the table and whatever the value that most rows have. ``by`` must have few values.
    """
    usable = rows.select(id_col, by).where(F.col(id_col).isNotNull() & F.col(by).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(by).count().collect()}
    if not counts:
        return usable.limit(0)
    limit = F.create_map(*chain.from_iterable(
        (F.lit(v), F.lit(min(_SCALE, 4 * per_value * _SCALE // n + 1))) for v, n in counts.items()))
    rank = F.expr(f"row_number() over (partition by `{by}` order by xxhash64(`{id_col}`), `{id_col}`)")
    return (
        usable.where(F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(_SCALE)) < limit[F.col(by)]).distinct()
        .withColumn("_rank", rank).where(F.col("_rank") <= per_value).drop("_rank"))


def fetched(docs: DataFrame, picked: DataFrame, id_col: str) -> DataFrame:
    """The documents of a bounded set of ids; the ids are broadcast, the texts stay where they are."""
    return docs.join(F.broadcast(picked), id_col)
