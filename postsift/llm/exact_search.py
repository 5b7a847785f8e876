"""Exact top-k search: tiled matrix products, partial selection per tile, lists merged in a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import tiles

_LONG = (1 << 63) - 1


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The integer inner products of two matrices of whole doubles, exact: in doubles while all sums stay below 2**53.

    Larger ones are computed with Python's integers; results outside 64 bits become the nearest 64-bit value.
    """
    reach = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if reach < 1 << 52:
        return (queries @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(rows).T
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def search(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, **grid: int,
) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query: query_id, rank (from 1), the row's id, score.

    Components are taken as floor(scale * x). Rows and queries without an id or a vector, or with a component that is null
    or not finite, take no part. Rows with the query's id are not its candidates; queries that share an id are one query.
    Ties go to the smaller id; fewer rows give shorter lists; no rows or no queries, no result. A shorter vector counts
    as filled up with zeros. Repeated rows are candidates each. Other columns are not read.
    """
    schema = "tile int, query_id long, id long, score long"
    names = ["tile", "query_id", "id", "score"]

    def cell(tile: int, left: pa.Table, right: pa.Table) -> pa.Table:
        kept: list[tuple] = []
        if len(left) and len(right):
            have, asked = tiles.both(left, right)
            for part in tiles.query_steps(len(asked), len(have)):
                some = asked.some(part)
                q, at, score = tiles.top_places(products(some.values, have.values), k, tiles.own_row(have, some))
                kept.append((some.ids[q], have.ids[at], score))
        columns = [np.concatenate(c) for c in zip(*kept)] if kept else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table([pa.array(np.full(len(columns[0]), tile, dtype=np.int32)), *map(pa.array, columns)], names=names)

    asked = tiles.one_per_id(tiles.scaled(queries, id_col, vector_col, scale=scale))
    found, n_tiles = tiles.over_grid(
        tiles.scaled(rows, id_col, vector_col, scale=scale), asked, rows.count(), queries.count(), cell, schema, **grid)
    best = tiles.best_of_tiles(found, n_tiles, ["query_id"], k, [F.desc("score"), F.col("id")])
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
