"""Encode texts to token ids and decode them again, for a tokenizer whose words end in a suffix.

Encoding merges over a heap and a linked list (see ``bpe``); decoding looks the
vocabulary string of every id up and joins the strings as the tokenizer does, by
one space where it declares no decoder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import bpe
from postsift.llm.common import arrow_map


#: Entries of one generation of each memo of a codec that lives as long as its task, so that what it keeps goes with it.
ENTRIES = 100_000


class Codec:
    """Ids are kept as their decimal strings joined by one space, which is what most uses want."""

    def __init__(self, path: str, entries: int = ENTRIES):
        merger = self.merger = bpe.merger(path)
        self.word = bpe.Memo(lambda w: " ".join(map(str, merger.encode(w.encode()))), entries).__getitem__
        self.chunk = bpe.Memo(lambda c: " ".join(map(self.word, bpe.normal_words(c))), entries).__getitem__
        self.strings = bpe.Memo(
            lambda ids: " ".join(merger.tokens[int(i)] for i in ids.split(" ")) if ids else "", entries).__getitem__

    def encode_chunks(self, text: str) -> list[str]:
        """The ids of each part of the text between white space, as decimal strings."""
        specials = self.merger.specials
        if any(map(text.__contains__, specials)):
            parts = self.merger.special_split.split(text)
        else:
            parts = [text]
        out: list[str] = []
        for part in parts:
            if part in specials:
                out.append(str(specials[part]))
            else:
                # no word crosses white space, and neither does composition or lower-casing
                out.extend(map(self.chunk, filter(None, part.replace("\n", " ").split(" "))))
        return [c for c in out if c]

    def decode_chunks(self, chunks: list[str]) -> str:
        return " ".join(map(self.strings, chunks))


@lru_cache(maxsize=2)
def worker_codec(path: str) -> Codec:
    """A codec that lives as long as the Python worker: its tasks share the memos, at the price of their memory."""
    return Codec(path, bpe.MEMO_ENTRIES)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids in ``ids_col`` (replaced if it is there). Null text: an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Codec(path)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            lists = [[int(i) for c in made.encode_chunks(t or "") for i in c.split(" ")]
                     for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, ids_col])

    rest = docs.drop(ids_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]
    return arrow_map(rest, run, ", ".join([*fields, f"`{ids_col}` array<int>"]))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """``docs`` with the decoded text of an array of ids in ``to_col`` (replaced). Null ids: null; no ids: ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.merger(path).tokens
        for batch in batches:
            at = batch.schema.names.index(ids_col)
            texts = [None if ids is None else " ".join(tokens[i] for i in ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to_col])

    rest = docs.drop(to_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]
    return arrow_map(rest, run, ", ".join([*fields, f"`{to_col}` string"]))


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False,
) -> DataFrame:
    """One row per input row: id, ``n_tokens``, digests of the ids and of the decoded text.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256`` over the decoded text. Null text
    counts as the empty text. With ``keep`` the words of one task are known to the next one of a Python worker. Ids of rows are passed on, null or repeated. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = worker_codec(path) if keep else Codec(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                chunks = made.encode_chunks(text or "")
                joined = " ".join(chunks)
                counts.append(joined.count(" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(made.decode_chunks(chunks).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = arrow_map(rows, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
