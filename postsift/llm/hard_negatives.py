"""Hard negatives: rows of another label that score nearly as well as an anchor's best rows of its own label.

Scores are exact integer inner products, by Kronecker packing. A bias makes the components of all
candidates non-negative; those of several candidates are put side by side into fields of one
wide integer, which is multiplied once per component of the anchor. The sum over the components holds
every candidate's score in its field, wide enough that no field reaches the next; a constant
keeps fields from going negative. Wide integers are kept in doubles, whose 53 bits hold them exactly, so one
matrix product multiplies them all; where not even one field fits there, Python's integers carry any width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import tiles
from postsift.llm.common import stored

#: Bits of a double that hold a packed sum.
CARRIER_BITS = 52
#: Candidates in one of Python's integers.
WIDE_FIELDS = 256
_LONG = (1 << 63) - 1


class Packed:
    """Candidates packed for products with anchors whose components add up to at most ``reach`` in absolute value."""

    def __init__(self, values: np.ndarray, reach: int, carrier_bits: int = CARRIER_BITS):
        self.n = len(values)
        low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
        self.bias = -low
        #: A field holds a signed sum of ``reach`` times the largest biased component.
        self.bits = (reach * (high - low)).bit_length() + 1
        self.fields = carrier_bits // self.bits
        if self.fields:
            self.words = -(-self.n // self.fields)
            self.packed = np.zeros((self.words, values.shape[1]))
            for f in range(self.fields):
                some = values[f * self.words: (f + 1) * self.words]
                self.packed[: len(some)] += (some + self.bias) * float(1 << self.bits * f)
        else:
            self.bytes = -(-self.bits // 8)
            biased = [[int(x) + self.bias for x in row] for row in values]
            self.wide = [
                [int.from_bytes(b"".join(x.to_bytes(self.bytes, "little") for x in column), "little")
                 for column in zip(*biased[at: at + WIDE_FIELDS])]
                for at in range(0, self.n, WIDE_FIELDS)]

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """The inner product of every anchor with every candidate (int64; beyond 64 bits, the nearest 64-bit value)."""
        if self.fields:
            half = sum(1 << self.bits * f + self.bits - 1 for f in range(self.fields))
            sums = (anchors @ self.packed.T).astype(np.int64) + half
            out = np.empty((len(anchors), self.fields * self.words), dtype=np.int64)
            back = (1 << self.bits - 1) + self.bias * anchors.sum(axis=1).astype(np.int64)[:, None]
            for f in range(self.fields):
                field = sums >> self.bits * f & (1 << self.bits) - 1
                out[:, f * self.words: (f + 1) * self.words] = field - back
            return out[:, : self.n]
        size = 8 * self.bytes
        out = np.empty((len(anchors), self.n), dtype=np.int64)
        for i, anchor in enumerate(anchors):
            parts = [int(a) for a in anchor]
            back = (1 << size - 1) + self.bias * sum(parts)
            for at, word in zip(range(0, self.n, WIDE_FIELDS), self.wide):
                fields = min(WIDE_FIELDS, self.n - at)
                half = int.from_bytes((b"\0" * (self.bytes - 1) + b"\x80") * fields, "little")
                raw = (sum(a * w for a, w in zip(parts, word)) + half).to_bytes(self.bytes * fields, "little")
                for f in range(fields):
                    score = int.from_bytes(raw[f * self.bytes: (f + 1) * self.bytes], "little") - back
                    out[i, at + f] = max(-_LONG, min(_LONG, score))
        return out


def reach_of(anchors: np.ndarray) -> int:
    """The largest sum of absolute components of an anchor."""
    if not anchors.size:
        return 0
    if float(np.abs(anchors).max()) * anchors.shape[1] < 1 << 52:
        return int(np.abs(anchors).sum(axis=1).max())
    return max(sum(abs(int(x)) for x in row) for row in anchors)


def _table(names: list[str], tile: int, kept: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*kept)] if kept else [np.zeros(0, dtype=np.int64)] * (len(names) - 1)
    return pa.table([pa.array(np.full(len(columns[0]), tile, dtype=np.int32)), *map(pa.array, columns)], names=names)


def positives(
    rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int, carrier_bits: int, **grid: int,
) -> DataFrame:
    """(anchor_id, place, positive_id, positive_score): the k best other rows of an anchor's label."""
    names = ["tile", "anchor_id", "positive_id", "positive_score"]

    def cell(tile: int, left: pa.Table, right: pa.Table) -> pa.Table:
        kept: list[tuple] = []
        if len(left) and len(right):
            have, asked = tiles.both(left, right)
            for label in np.unique(asked.labels):
                mine, ask = have.some(have.labels == label), asked.some(asked.labels == label)
                if not len(mine):
                    continue
                packed = Packed(mine.values, reach_of(ask.values), carrier_bits)
                for part in tiles.query_steps(len(ask), len(mine)):
                    some = ask.some(part)
                    q, at, score = tiles.top_places(packed.products(some.values), k, tiles.own_row(mine, some))
                    kept.append((some.ids[q], mine.ids[at], score))
        return _table(names, tile, kept)

    found, n_tiles = tiles.over_grid(
        rows, anchors, n_rows, n_anchors, cell, "tile int, anchor_id long, positive_id long, positive_score long", **grid)
    best = tiles.best_of_tiles(found, n_tiles, ["anchor_id"], k, [F.desc("positive_score"), F.col("positive_id")])
    return best.withColumnRenamed("rank", "place")


def mine(
    rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
    carrier_bits: int = CARRIER_BITS, **grid: int,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    An anchor's positives are its ``n_positives`` best other rows of its label; for each of them its negatives are the
    ``n_negatives`` best rows of another label whose score is between ``low`` and ``high`` per cent of the positive's.
    Components are taken as floor(scale * x), scores are integer inner products with the anchor, ties go to the smaller
    id. Rows without an id, a label or a vector, or with a component that is null or not finite, take no part. Rows with the
    anchor's id are not its candidates; anchors that share an id are one anchor (the least label and vector); other repeated
    rows count each. Shorter vectors count as filled up with zeros. An anchor without positives or negatives has no rows; no
    rows or no anchors, no result. Other columns are not read.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    ready = tiles.scaled(rows, id_col, vector_col, label_col, scale)
    asked = tiles.one_per_id(tiles.scaled(anchors, id_col, vector_col, label_col, scale))
    best = stored(positives(ready, asked, n_rows, n_anchors, n_positives, carrier_bits, **grid), "positives")
    goals = best.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("goals"))
    asked = asked.join(goals, "id").select("id", "label", "wide", "items", "goals.place", F.col("goals.positive_score").alias("goal"))
    names = ["tile", "anchor_id", "place", "negative_id", "negative_score"]

    def cell(tile: int, left: pa.Table, right: pa.Table) -> pa.Table:
        kept: list[tuple] = []
        if len(left) and len(right):
            have, ask = tiles.both(left, right)
            sorted_right = right.sort_by([("id", "ascending"), ("label", "ascending"), ("items", "ascending")])
            places = sorted_right.column("place").to_pylist()
            wanted = sorted_right.column("goal").to_pylist()
            packed = Packed(have.values, reach_of(ask.values), carrier_bits)
            for part in tiles.query_steps(len(ask), len(have)):
                scores = packed.products(ask.values[part])
                # per cent bounds in whole numbers: the least and the largest score that fit some positive
                least = np.array([min(-(-low * p // 100) for p in ps) for ps in wanted[part]])
                most = np.array([max(high * p // 100 for p in ps) for ps in wanted[part]])
                fits = (scores >= least[:, None]) & (scores <= most[:, None])
                fits &= have.labels[None, :] != ask.labels[part][:, None]
                fits &= have.ids[None, :] != ask.ids[part][:, None]
                anchor, at = np.nonzero(fits)
                cuts = np.searchsorted(anchor, np.arange(len(scores) + 1))
                for i in range(len(scores)):
                    here = at[cuts[i]: cuts[i + 1]]
                    if not len(here):
                        continue
                    here = here[np.argsort(-scores[i, here], kind="stable")]
                    falling = -scores[i, here]
                    for place, goal in zip(places[part][i], wanted[part][i]):
                        first = int(np.searchsorted(falling, -(high * goal // 100), "left"))
                        last = int(np.searchsorted(falling, -low * goal // 100, "right"))
                        some = here[first: min(last, first + n_negatives)]
                        if len(some):
                            kept.append((
                                np.full(len(some), ask.ids[part][i]), np.full(len(some), place, dtype=np.int64), have.ids[some],
                                scores[i, some]))
        return _table(names, tile, kept)

    found, n_tiles = tiles.over_grid(
        ready, asked, n_rows, n_anchors, cell, "tile int, anchor_id long, place long, negative_id long, negative_score long", **grid)
    ranked = tiles.best_of_tiles(
        found, n_tiles, ["anchor_id", "place"], n_negatives, [F.desc("negative_score"), F.col("negative_id")])
    return ranked.join(best, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
