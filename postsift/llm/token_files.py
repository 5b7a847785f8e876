"""Token ids of a corpus as raw binary shards, with a minimal perfect hash index for access by key.

A data set is a folder of shards, numbered in ascending key order:

* ``shard-NNNNNN.ids``: the ids of its documents one after the other, little-endian, two bytes each if the
  vocabulary has at most 65,536 entries, else four. Nothing else, so it can be mapped into memory.
* ``shard-NNNNNN.idx``: a line of JSON (sizes), then arrays: the keys and the document offsets in shard order, and the
  hash: bit vectors of a few levels, a rank directory, and for each slot the document's place and a fingerprint.

Looking a key up takes its bit at the first level where it stands alone, the rank of this bit (a
slot), a check of the stored fingerprint, and two offsets: constant time whatever the size. The levels are built by
hashing the keys left over into 1.5 times as many bits and keeping those that do not collide.

Each task writes its own range of keys under a temporary name and renames it, so a repeated attempt leaves the same file.
The folder must be one that every worker reaches through ``pyarrow.fs`` (a shared file system, HDFS, S3).
"""

from __future__ import annotations

import json
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm import bpe
from postsift.llm.common import arrow_map
from postsift.llm.flat import mix

GAMMA = 1.5
#: Entries of one generation of the encoder's memos: words, and parts of text between spaces.
WORD_ENTRIES, SPACED_ENTRIES = 500_000, 400_000
U64 = np.uint64


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U64) ^ mix(np.array([level + 1], dtype=U64)))


class PerfectHash:
    """Maps n distinct keys one-to-one to 0 .. n - 1; other keys to anything, or to nothing (-1)."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # ones before each 64-bit word: the rank directory
        ones = np.bitwise_count(bits.view(U64)).astype(np.int64) if len(bits) else np.zeros(0, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, parts, left, level = [], [], keys, 0
        while len(left):
            size = (int(len(left) * GAMMA) + 64) // 64 * 64
            at = (_hash(left, level) % U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            left, level = left[~alone[at]], level + 1
        return PerfectHash(sizes, np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        words = self.bits.view(U64) if len(self.bits) else np.zeros(0, dtype=U64)
        for level, size in enumerate(self.sizes):
            at = (_hash(keys[open_], level) % U64(size)).astype(np.int64) + self.starts[level]
            word, bit = words[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> U64(32)).astype(np.uint32)


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if uri.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def _put(fs: pyarrow.fs.FileSystem, path: str, parts: list) -> None:
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        for piece in parts:
            out.write(piece)
    fs.move(part, path)


def index_bytes(keys: np.ndarray, offsets: np.ndarray, width: int) -> list[bytes]:
    """The ``.idx`` file of a shard: ``keys`` in shard order (a repeated key: its first document), offsets in ids."""
    unique, place = np.unique(keys, return_index=True)
    table = PerfectHash.build(unique)
    places = np.empty(len(unique), dtype=np.int64)
    prints = np.empty(len(unique), dtype=np.uint32)
    slots = table.slots(unique)
    places[slots], prints[slots] = place, _fingerprint(unique)
    head = {"docs": len(keys), "keys": len(unique), "width": width, "levels": table.sizes}
    return [json.dumps(head).encode() + b"\n", keys.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(),
            places.astype("<i8").tobytes(), prints.astype("<u4").tobytes(), table.bits.tobytes()]


class Shard:
    """A shard opened for reading: ``find`` a key's place, then take its ids."""

    def __init__(self, folder: str, number: int):
        fs, root = _file_system(folder)
        self.path = f"{root}/shard-{number:06d}.ids"
        with fs.open_input_stream(f"{root}/shard-{number:06d}.idx") as f:
            raw = f.read()
        line, _, body = raw.partition(b"\n")
        head = json.loads(line)
        docs, keys = head["docs"], head["keys"]
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, dtype=kind, count=n, offset=at)
            at += got.nbytes
            return got

        self.keys, self.offsets = take("<i8", docs), take("<i8", docs + 1)
        self.places, self.prints = take("<i8", keys), take("<u4", keys)
        self.table = PerfectHash(head["levels"], np.frombuffer(body[at:], dtype=np.uint8))
        self.kind = np.dtype("<u2" if head["width"] == 2 else "<u4")
        self.file = fs.open_input_file(self.path)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key's document in the shard, -1 where the fingerprint shows it is not here."""
        slots = self.table.slots(np.asarray(keys, dtype=np.int64))
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == _fingerprint(np.asarray(keys)[ok])
        return np.where(ok, self.places[np.where(ok, slots, 0)] if len(self.places) else -1, -1)

    def ids(self, place: int) -> np.ndarray:
        start, end = int(self.offsets[place]), int(self.offsets[place + 1])
        raw = self.file.read_at((end - start) * self.kind.itemsize, start * self.kind.itemsize)
        return np.frombuffer(raw, dtype=self.kind)


class Encoder:
    """Packed ids of whole texts as the tokenizers library gives them.

    The library splits and merges; the texts are handed over in words, each distinct word once for a memo of
    bounded size, since a word's ids do not depend on its neighbours.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.kind = "<u2" if library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        model, letters = library.model, {b: c for b, c in enumerate(bpe.byte_alphabet())}
        self.specials = {t.content: np.array([i], self.kind).tobytes() for i, t in library.get_added_tokens_decoder().items()}
        self.cut = bpe.merger(path).special_split

        pack = "H" if self.kind == "<u2" else "I"

        def word(w: str) -> bytes:
            ids = array(pack, [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))])
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()

        self.word = bpe.Memo(word, WORD_ENTRIES).__getitem__
        self.spaced = bpe.Memo(
            lambda part: b"".join(map(self.word, bpe.byte_level_words(" " + part))), SPACED_ENTRIES).__getitem__

    def plain(self, text: str) -> bytes:
        return b"".join(
            b"".join((*map(self.word, bpe.byte_level_words(first)), *map(self.spaced, rest)))
            for first, rest in bpe.spaced_parts(text))

    def __call__(self, text: str) -> bytes:
        if any(map(text.__contains__, self.specials)):
            return b"".join(self.specials.get(p) or self.plain(p) for p in self.cut.split(text) if p)
        return self.plain(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """Encode every text and write the shards below ``folder``; returns the manifest, one row per shard.

    Columns: ``shard``, ``docs``, ``ids``, ``first`` and ``last`` key. ``end_id`` is appended to each document. Null text
    counts as the empty text. A null id comes first, is written as the smallest 64-bit integer and can be found by it. Rows
    that share an id stand next to each other in any order; the index finds the first. Other columns are not read. An empty
    table writes no shard. Runs the job when called, once: the manifest is a table of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        kind = np.dtype(encode.kind)
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        number = TaskContext.get().partitionId()
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        keys, lengths, out, part = [], [], None, ""
        for batch in batches:
            if batch.num_rows and out is None:
                part = f"{root}/shard-{number:06d}.ids.{uuid.uuid4().hex}.part"
                out = fs.open_output_stream(part)
            for text in batch.column("text").to_pylist():
                ids = encode(text or "")
                out.write(ids)
                out.write(end)
                lengths.append((len(ids) + len(end)) // kind.itemsize)
            keys.append(np.asarray(batch.column("key")))
        if out is None:
            return
        out.close()
        fs.move(part, f"{root}/shard-{number:06d}.ids")
        key = np.concatenate(keys)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        _put(fs, f"{root}/shard-{number:06d}.idx", index_bytes(key, offsets, kind.itemsize))
        yield pa.RecordBatch.from_pydict({
            "shard": [number], "docs": [len(key)], "ids": [int(offsets[-1])], "first": [int(key[0])], "last": [int(key[-1])]})

    made = arrow_map(rows, run, "shard long, docs long, ids long, first long, last long")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(made.schema).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of the shards, through their indexes: id, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (over the ids as little-endian unsigned 32-bit integers)."""
    # one row per shard; the running sum is over that small table
    base = manifest.alias("a").join(manifest.alias("b"), F.expr("b.shard < a.shard"), "left").groupBy("a.shard").agg(
        F.coalesce(F.sum("b.ids"), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, base_at in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(folder, number)
                places = shard.find(shard.keys)
                again = np.concatenate([[False], shard.keys[1:] == shard.keys[:-1]])
                places = np.where(again, np.arange(len(places)), places)
                crcs = [zlib.crc32(shard.ids(p).astype("<u4").tobytes()) for p in places]
                keys = pa.array(shard.keys, mask=shard.keys == -(1 << 63))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(shard.offsets[places] + base_at),
                     pa.array(shard.offsets[places + 1] - shard.offsets[places]), pa.array(crcs, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.sparkSession.sparkContext.defaultParallelism
    out = arrow_map(base.repartition(max(shards, 1) * 4, "shard"), run, "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def lookup(keys: DataFrame, manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """The ids of the documents asked for: rows (id, ``ids``), none for a key that is not there. Null keys are skipped."""
    wanted = keys.select(F.col(id_col).cast("long").alias("key")).where("key is not null").distinct()
    placed = wanted.join(manifest, F.expr("key between first and last")).select("key", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, None
        for batch in batches:
            for key, at in zip(batch.column("key").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                if at != number:
                    shard, number = Shard(folder, at), at
                place = int(shard.find(np.array([key]))[0])
                if place >= 0 and shard.keys[place] == key:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([shard.ids(place).astype(np.int64)], pa.list_(pa.int64()))], names=["id", "ids"])

    out = arrow_map(placed.repartition("shard").sortWithinPartitions("shard", "key"), run, "id long, ids array<long>")
    return out.withColumnRenamed("id", id_col)
