"""Token counts by byte-pair merging: initial symbols minus merges, no ids made.

The words of the byte-level rule are counted once per task (see ``bpe.Memo``), and
so are the pieces of text between spaces, which hold one or a few words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import bpe
from postsift.llm.common import arrow_map

WORD_ENTRIES = 500_000


class Counter:
    """Counts the tokens of texts as the byte-level tokenizer of ``path`` does; special strings count as one."""

    def __init__(self, path: str):
        merger = bpe.merger(path)
        self.merger = merger
        self.word = bpe.Memo(lambda w: merger.count(w.encode()), WORD_ENTRIES).__getitem__
        self.spaced = bpe.Memo(lambda part: sum(map(self.word, bpe.byte_level_words(" " + part)))).__getitem__

    def __call__(self, text: str) -> int:
        specials = self.merger.specials
        if any(map(text.__contains__, specials)):
            return sum(1 if p in specials else self.plain(p) for p in self.merger.special_split.split(text))
        return self.plain(text)

    def plain(self, text: str) -> int:
        return sum(
            sum(map(self.word, bpe.byte_level_words(first))) + sum(map(self.spaced, rest))
            for first, rest in bpe.spaced_parts(text))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``path`` is the tokenizer file, at the same place on every worker. Null text counts as the empty text: 0
    bytes, 0 tokens. Ids are passed on, null or repeated. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([count(t) for t in texts], pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = arrow_map(rows, run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
