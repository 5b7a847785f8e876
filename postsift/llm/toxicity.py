"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits in lower case. The features of a text are the
buckets, out of ``BUCKETS``, that its words, pairs of neighbours and pairs with one word between hash to; a bucket
counts once, so a long text is not toxic for its length. Buckets of fewer than ``MIN_TEXTS`` sampled texts stay out. Every coordinate has its own learning rate, and the L1 term
keeps weights at exactly zero unless their gradients insist: what remains is a few thousand weights, sent to the tasks.

Learning is sequential by nature, so it takes a bounded sample of labelled rows and runs in one task; scoring is one pass
over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import arrow_map
from postsift.llm.flat import Block, blocks, mix
from postsift.llm.sampling import fetched, picked_rows

BUCKETS = 1 << 18
#: The bounded sample: rows of each label.
SAMPLE_ROWS = 4000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 10.0, 0.1, 5
#: A bucket takes part in learning if this many sampled texts have it.
MIN_TEXTS = 5
THRESHOLD = 0.7

OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[48:58] = OUTSIDE[65:91] = OUTSIDE[97:123] = False
OUTSIDE[128:] = False


@dataclass(frozen=True)
class Weights:
    """Nonzero weights by bucket, and the bias."""

    bucket: tuple[int, ...]
    weight: tuple[float, ...]
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[list(self.bucket)] = self.weight
        return out


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each row, distinct and sorted within the row, and rows + 1 offsets."""
    words, row = block.word_hashes(), block.row_of_word()
    found, of = [words], [row]
    for gap, seed in ((1, 0x2545F4914F6CDD1D), (2, 0x9FB21C651E98DF25)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            found.append(mix(words[:-gap] * np.uint64(seed) + words[gap:])[same])
            of.append(row[gap:][same])
    code = np.concatenate(of).astype(np.int64) * BUCKETS + (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)
    code = np.unique(code)
    return code % BUCKETS, np.searchsorted(code, np.arange(block.rows + 1) * BUCKETS)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text"), lower=True, outside=OUTSIDE):
            bucket, at = features(block)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(block.first, block.rows), batch.column("label").slice(block.first, block.rows), lists],
                names=["id", "label", "buckets"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL-proximal over the sample in its given order, ``EPOCHS`` times."""
    examples = []
    for batch in batches:
        labels = batch.column("label").to_pylist()
        examples.extend(zip((np.asarray(x.values) for x in batch.column("buckets")), labels, strict=True))
    if len({label for _, label in examples}) < 2:
        return
    texts = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, _ in examples:
        texts[bucket] += 1
    examples = [(np.append(bucket[texts[bucket] >= MIN_TEXTS], BUCKETS), label) for bucket, label in examples]
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(EPOCHS):
        for at, label in examples:  # the last coordinate of each is the bias
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            w[-1] = -zi[-1] / ((BETA + root[-1]) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            grown = np.sqrt(ni + g * g)
            z[at] += g - (grown - root) / ALPHA * w
            n[at] += g * g
    root = np.sqrt(n)
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + root) / ALPHA + L2))
    w[-1] = -z[-1] / ((BETA + root[-1]) / ALPHA)
    kept = np.append(np.flatnonzero(w[:-1]), BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int64)), pa.array(w[kept])], names=["bucket", "weight"])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows_per_label: int = SAMPLE_ROWS,
) -> Weights:
    """Weights from at most ``rows_per_label`` documents of each label (0 or 1, chosen by hash of the id).

    Labels that are null or neither, ids without a document, and documents without an id are not used. An id labelled both
    ways counts as 1. With fewer than two labels left, all weights are 0. The driver gets at most ``BUCKETS`` weights.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = picked_rows(marked, "id", "label", rows_per_label)
    sample = fetched(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chosen, "id")
    kind = sample.schema["id"].dataType.simpleString()
    rows = arrow_map(sample.select("id", "label", "text"), _feature_rows, f"id {kind}, label int, buckets array<int>")
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    learned = arrow_map(ordered, _learn, "bucket long, weight double").collect()
    by = {r.bucket: r.weight for r in learned}
    bias = by.pop(BUCKETS, 0.0)
    return Weights(tuple(by), tuple(by.values()), bias)


def score(docs: DataFrame, weights: Weights, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more) added, or replaced.

    A null text counts as the empty text, which has the score of the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rest = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = shared.value.dense(), shared.value.bias
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for block in blocks(batch.column(batch.schema.names.index(text_col)), lower=True, outside=OUTSIDE):
                bucket, at = features(block)
                sums = np.concatenate([[0.0], np.cumsum(dense[bucket])])
                total[block.first: block.first + block.rows] = sums[at[1:]] - sums[at[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(total + bias, -35, 35))))],
                names=[*batch.schema.names, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]
    return arrow_map(rest, run, ", ".join([*fields, "score double"])).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
