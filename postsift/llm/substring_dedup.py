"""Substring dedup by difference-cover anchors.

A *window* is ``size`` consecutive words of one text. A word is removed when a
window over it also starts in a document with a smaller id. Windows are judged on
the input, not on what is left.

Hashing every window of the corpus and shuffling it would move more than the
corpus itself. Instead short *anchors* of ``size - period + 1`` words are hashed,
and only at positions whose remainder modulo ``period`` is in a difference cover:
for any two positions i and j some shift below ``period`` puts both i + shift and
j + shift into the cover, so two equal windows always share an aligned anchor.

1. Anchors (about a fifth of all positions) are grouped; those of one document
   alone drop out.
2. Texts with shared anchors extend them to the windows that contain one. These
   windows are grouped by 96 bits of two independent hashes, and all but those of the
   smallest id are covered.
3. Covered words are dropped and the rest joined by one space.

Equal texts are folded first: all but the smallest id of a text lose every word.
Equal anchors and windows of one block of texts meet before the shuffle, which
sends one row of them on, so a passage with a third of all documents is spread.
Groups are read in sorted order and never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import arrow_map
from postsift.llm.flat import WORD_BASES, Block, blocks, mix, run_hashes, segments, signed, windows

WINDOW_WORDS = 50
#: A perfect difference set of 31; every remainder is a difference of two of its members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def _cover_mask(period: int, cover: tuple[int, ...]) -> np.ndarray:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover does not have every difference")
    mask = np.zeros(period, dtype=bool)
    mask[list(cover)] = True
    return mask


def _anchors(block: Block, size: int, period: int, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, row and hash of every anchor of texts with at least ``size`` words."""
    length = size - period + 1
    first, row = windows(block, length)
    keep = mask[(first - block.word_at[row]) % period] & (block.counts[row] >= size)
    first, row = first[keep], row[keep]
    return first, row, mix(run_hashes(block.word_hashes(), first, first + length, WORD_BASES[0]))


def _anchor_rows(size: int, period: int, mask: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for block in blocks(batch.column("body")):
                _, row, key = _anchors(block, size, period, mask)
                doc = ids[block.first + row]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                again = np.zeros(len(key), dtype=bool)
                again[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
                key, doc = key[~again], doc[~again]
                at = segments(key)
                lengths = np.diff(at)
                many = np.repeat(lengths > 1, lengths)
                lead = np.zeros(len(key), dtype=bool)
                lead[at[:-1]] = True
                # kind 0: the only document of the block with this anchor; 1: the first of several; 2: another of them
                kind = np.where(lead, many, 2).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(doc), pa.array(kind)], names=["k", "doc", "kind"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the anchors of more than one document; the rows come sorted by anchor and document."""
    held = None  # (key, doc, known): the last row of the part before, and whether it was already passed on
    for batch in batches:
        key, doc = np.asarray(batch.column("k")), np.asarray(batch.column("doc"))
        known = np.asarray(batch.column("kind")) > 0
        if held is not None:
            key, doc = np.append(held[0], key), np.append(held[1], doc)
            known = np.append(held[2] > 0, known)
        if len(key) == 0:
            continue
        at = segments(key)
        lengths = np.diff(at)
        # kinds 1 and 2 are known to be shared; kind 2 rows are routed by document, so are groups of their own here
        out = np.repeat(lengths > 1, lengths) | known
        passed = out.copy()
        if held is not None and held[2] == 2:
            out[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(doc[out])], names=["k", "doc"])
        held = (key[-1], doc[-1], 2 if passed[-1] else 0)


def _window_rows(size: int, period: int, mask: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = np.asarray(batch.column("id")), np.asarray(batch.column("tag"))
            lists = batch.column("keys").cast(pa.large_list(pa.int64()))
            for block in blocks(batch.column("body")):
                part = lists.slice(block.first, block.rows)
                flat, per_row = np.asarray(part.flatten()), np.asarray(part.value_lengths().fill_null(0))
                first, row, key = _anchors(block, size, period, mask)
                # an anchor is shared if (row, key) is among the marks of its row
                marks = mix(flat.view(np.uint64) ^ mix(np.repeat(np.arange(block.rows), per_row).astype(np.uint64)))
                hit = np.isin(mix(key ^ mix(row.astype(np.uint64))), marks)
                first = first[hit]
                # a window is a candidate if it has a shared anchor at one of its first `period` words
                seen = np.zeros(len(block.starts) + 1, dtype=np.int64)
                np.add.at(seen, first + 1, 1)
                seen = np.cumsum(seen)
                start, row = windows(block, size)
                keep = seen[start + period] > seen[start] if len(start) else np.zeros(0, dtype=bool)
                start, row = start[keep], row[keep]
                h1 = signed(mix(run_hashes(block.word_hashes(), start, start + size, WORD_BASES[0])))
                h2 = mix(run_hashes(block.word_hashes(lane=1), start, start + size, WORD_BASES[1]))
                h2 = (h2 >> np.uint64(32)).astype(np.int32)
                if len(h1) == 0:
                    continue
                doc, tag = ids[block.first + row], tags[block.first + row]
                pos = (start - block.word_at[row]).astype(np.int32)
                order = np.lexsort((doc, h2, h1))
                fresh = np.ones(len(h1), dtype=bool)
                fresh[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
                least = np.empty(len(h1), dtype=np.int64)
                least[order] = doc[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array(doc), pa.array(tag), pa.array(pos), pa.array(doc > least)],
                    names=["h1", "h2", "doc", "tag", "pos", "later"])
    return run


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the windows that a smaller document has too; the rows come sorted by hash and document."""
    held = None
    for batch in batches:
        h1, h2, doc = (np.asarray(batch.column(c)) for c in ("h1", "h2", "doc"))
        later = np.asarray(batch.column("later").to_numpy(zero_copy_only=False), dtype=bool)
        if len(h1) == 0:
            continue
        fresh = np.ones(len(h1), dtype=bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        if held is not None and held[0] == h1[0] and held[1] == h2[0]:
            least[: np.argmax(fresh[1:]) + 1 if fresh[1:].any() else len(least)] = held[2]
        out = later | (doc > least)
        held = (h1[-1], h2[-1], least[-1])
        picked = pa.array(out)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).filter(picked) for c in ("doc", "tag", "pos")], names=["doc", "tag", "pos"])


def _cut(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, at, copy in zip(batch.column("body"), batch.column("at"), batch.column("copy"), strict=True):
                words = (text.as_py() or "").encode().split()
                removed = 0
                n_words.append(len(words))
                starts = at.values
                if copy.as_py() and len(words) >= size:
                    removed, words = len(words), []
                elif starts is not None and len(starts):
                    depth = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(depth, np.asarray(starts), 1)
                    np.add.at(depth, np.asarray(starts) + size, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    removed = int(gone.sum())
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            out = {"id": batch.column("id"), "n_words": pa.array(n_words, pa.int64()),
                   "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                out["kept_text"] = pa.array(kept_texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)
    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW_WORDS,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text``.

    Null text: no words. A null id never removes and loses nothing. Rows that share an id count as one
    document: they do not remove each other's words, and each keeps its own text. A repeat within one
    document stays. Other columns are not read. An empty table gives an empty result.
    """
    if period > size:
        raise ValueError("an anchor needs at least one word: period must not exceed size")
    mask = _cover_mask(period, tuple(cover))
    # the tag tells rows that share an id apart
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("tag"))
    known = texts.where("id is not null")
    anchors = arrow_map(known.select("id", "body"), _anchor_rows(size, period, mask), "k long, doc long, kind byte")
    shared = arrow_map(
        anchors.repartition(F.when(F.col("kind") == 2, F.col("doc")).otherwise(F.col("k")))
        .sortWithinPartitions(F.col("kind") == 2, "k", "doc"),
        _shared, "k long, doc long")
    marks = shared.groupBy(F.col("doc").alias("id")).agg(F.collect_set("k").alias("keys"))
    # a later exact copy loses every word, so only the first one of a text has to be compared
    prints = known.select("id", "tag", F.md5("body").alias("print"))
    first = prints.groupBy("print").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last")
    copies = (
        prints.join(first, "print").where("id > lead").groupBy("id").agg(F.collect_set("tag").alias("copies")))
    is_copy = F.coalesce(F.expr("array_contains(copies, tag)"), F.lit(False))
    found = arrow_map(
        known.join(marks, "id").join(copies, "id", "left").where(~is_copy).select("id", "body", "tag", "keys"),
        _window_rows(size, period, mask), "h1 long, h2 int, doc long, tag long, pos int, later boolean")
    covered = arrow_map(
        found.repartition(F.when(F.col("later"), F.col("doc")).otherwise(F.col("h1")))
        .sortWithinPartitions("later", "h1", "h2", "doc"),
        _covered, "doc long, tag long, pos int")
    spans = covered.groupBy(F.col("doc").alias("id")).agg(F.collect_set(F.struct("tag", "pos")).alias("at"))
    # both joins read one shuffle of the texts
    joined = known.join(spans, "id", "left").join(copies, "id", "left").select(
        "id", "body", F.expr("transform(filter(at, x -> x.tag = tag), x -> x.pos)").alias("at"), is_copy.alias("copy"))
    joined = joined.unionByName(texts.where("id is null").select(
        "id", "body", F.lit(None).cast("array<int>").alias("at"), F.lit(False).alias("copy")))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return arrow_map(joined, _cut(size, with_text), schema).withColumnRenamed("id", id_col)
