"""Integer vectors in tiles: a grid of cells, each a block of queries against a tile of rows.

Every query must meet every row, which is work that grows with their product. Rows are
dealt to tiles and queries to blocks of bounded size; a cell (tile, block) is one task's
work and holds both in memory. Rows are copied once per block, queries once per tile, so
the shuffle is the rows times the number of blocks, which is one up to ``BLOCK_QUERIES``
queries, and the queries times the number of tiles. What a cell finds are lists of at most k
entries per query; ``best_of_tiles`` merges them level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.llm.common import arrow_map

#: Rows of a tile and queries of a block, at most (on average).
TILE_ROWS = 1 << 16
BLOCK_QUERIES = 1 << 16
#: Small tables are cut further, for more tasks, but not below this.
LEAST_TILE_ROWS = 1 << 10
#: Entries of one matrix product.
PRODUCT_ENTRIES = 1 << 22
#: How many lists are merged into one at each level.
FAN_IN = 64

_NARROW = 1 << 15


def scaled(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None = None, scale: int = 256) -> DataFrame:
    """(id long, label long, wide boolean, items binary): each component as floor(scale * x), x as double.

    Rows without an id, a vector or (where asked for) a label, and those with a component that is null or not finite
    (also after scaling), are left out. ``items`` holds 16-bit integers, or doubles if ``wide``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = pc.and_(batch.column("id").is_valid(), pc.and_(batch.column("label").is_valid(), batch.column("v").is_valid()))
            batch = batch.filter(use)
            lists = batch.column("v")
            ends = np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))
            at = np.concatenate([[0], ends])
            x = np.floor(lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * float(scale))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            fine = bad[at[1:]] == bad[at[:-1]]
            wide = not (np.abs(x[np.isfinite(x)]) < _NARROW).all()
            keep = np.repeat(fine, np.diff(at))
            items = x[keep].astype("<f8" if wide else "<i2")
            sizes = np.diff(at)[fine] * items.itemsize
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            n, some = int(fine.sum()), pa.array(fine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(some), batch.column("label").filter(some), pa.array([wide] * n, pa.bool_()),
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(items.tobytes())])],
                names=["id", "label", "wide", "items"])

    label = F.lit(0) if label_col is None else F.col(label_col)
    picked = rows.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"))
    return arrow_map(picked, run, "id long, label long, wide boolean, items binary")


def one_per_id(queries: DataFrame) -> DataFrame:
    """Queries that share an id are one query: the least of them."""
    rest = [c for c in queries.columns if c != "id"]
    return queries.groupBy("id").agg(F.min(F.struct(*rest)).alias("q")).select("id", "q.*")


@dataclass
class Vectors:
    """Rows of one side of a cell in ascending order of id. Shorter vectors are filled up with zeros."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray    # doubles, each an integer

    def __len__(self) -> int:
        return len(self.ids)

    def some(self, which) -> Vectors:
        return Vectors(self.ids[which], self.labels[which], self.values[which])


def vectors(table: pa.Table, width: int | None = None) -> Vectors:
    table = table.sort_by([("id", "ascending"), ("label", "ascending"), ("items", "ascending")])
    wide = table.column("wide").to_numpy()
    items = table.column("items").to_pylist()
    rows = [np.frombuffer(b, "<f8" if w else "<i2") for b, w in zip(items, wide)]
    most = max([len(r) for r in rows], default=0) if width is None else width
    values = np.zeros((len(rows), most))
    for i, r in enumerate(rows):
        values[i, : len(r)] = r
    return Vectors(table.column("id").to_numpy(), table.column("label").to_numpy(), values)


def both(left: pa.Table, right: pa.Table) -> tuple[Vectors, Vectors]:
    """Rows and queries of a cell, as wide as the longest vector of the two."""
    rows, queries = vectors(left), vectors(right)
    most = max(rows.values.shape[1], queries.values.shape[1])
    for side in (rows, queries):
        side.values = np.pad(side.values, ((0, 0), (0, most - side.values.shape[1])))
    return rows, queries


def query_steps(queries: int, rows: int) -> Iterator[slice]:
    """Slices of the queries whose products with the rows are of bounded size."""
    step = max(1, PRODUCT_ENTRIES // max(rows, 1))
    for at in range(0, queries, step):
        yield slice(at, min(queries, at + step))


def top_places(scores: np.ndarray, k: int, skip: Callable[[int], slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the k best columns of each row; the first of equal scores wins.

    ``scores`` are int64; ``skip(q)`` says which columns query ``q`` leaves out. Scores and places are joined into one
    number each, so a partial selection finds exactly the best ones.
    """
    m, n = scores.shape
    k = min(k, n)
    if not (m and k):
        return (np.zeros(0, dtype=np.int64),) * 3
    biggest = int(max(scores.max(), -int(scores.min())))
    gone = np.zeros(scores.shape, dtype=bool)
    for q in range(m):
        gone[q, skip(q)] = True
    if (biggest + 2) * n < 1 << 62:
        keys = scores * n + np.arange(n - 1, -1, -1)
        keys[gone] = -(biggest + 2) * n
        some = np.argpartition(keys, n - k, axis=1)[:, n - k:]
    else:
        order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, gone), axis=1)
        some = order[:, :k]
    rows = np.repeat(np.arange(m), k)
    some = some.ravel()
    use = ~gone[rows, some]
    return rows[use], some[use], scores[rows[use], some[use]]


def own_row(rows: Vectors, queries: Vectors) -> Callable[[int], slice]:
    """Where the rows with a query's own id are."""
    low, high = np.searchsorted(rows.ids, queries.ids, "left"), np.searchsorted(rows.ids, queries.ids, "right")
    return lambda q: slice(low[q], high[q])


def over_grid(
    rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int,
    fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str, tile_rows: int = TILE_ROWS,
    block_queries: int = BLOCK_QUERIES, least: int = LEAST_TILE_ROWS,
) -> tuple[DataFrame, int]:
    """``fn(tile, rows, queries)`` for every cell of the grid, and the number of tiles.

    Rows are dealt by a running number of the scan, so equal ids and equal vectors are no hot tile.
    """
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = max(1, -(-n_rows // tile_rows), min(parallel, -(-n_rows // least)))
    blocks = max(1, -(-n_queries // block_queries))
    tile = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tiles)).cast("int")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = rows.withColumn("tile", tile).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", block).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    # a number of partitions of its own: cells are few and heavy, so small ones must not be put together
    cells = tiles * blocks
    left, right = (side.repartition(cells, "tile", "block").groupBy("tile", "block") for side in (left, right))

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(key[0].as_py(), a, b)

    return left.cogroup(right).applyInArrow(run, schema), tiles


def best_of_tiles(lists: DataFrame, tiles: int, by: list[str], k: int, order: list[Column], fan_in: int = FAN_IN) -> DataFrame:
    """The k best entries of all tiles for each ``by``, in ``rank`` from 1: merged ``fan_in`` tiles at a time."""
    while tiles > fan_in:
        tiles = -(-tiles // fan_in)
        lists = lists.withColumn("tile", F.floor(F.col("tile") / fan_in).cast("int"))
        lists = _ranked(lists, [*by, "tile"], k, order).drop("rank")
    return _ranked(lists, by, k, order).drop("tile")


def _ranked(lists: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
