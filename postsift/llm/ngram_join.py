"""Jaccard join of word shingles by parity sketches.

Two sets link when 5 * intersection >= 4 * union, that is, when their symmetric
difference has at most (a + b) / 9 elements. A *parity sketch* deals the elements
of a set to segments by hash and keeps, per segment, the XOR of their hashes and
their number. Every element of the symmetric difference changes one segment, so the
number of different segments is a lower bound of the difference.

1. Sets with the same fingerprint (two 64-bit sums of hashes and the size) fold to
   their smallest document.
2. Sizes are cut into bands half as wide again as they begin; a set takes part in
   its own band and, if a partner may be there, in the next one. In a band of K
   segments two linked sets agree on at least K - D segments, D = (a + b) / 9, so
   by the pigeonhole they share one of the D + 1 segments that come first in any
   order fixed for all. Full segments come first here: they are the rarest.
3. Equal segments meet in one sorted pass. Each set is compared with the smallest
   document of its segment, exactly, and linked sets become components.
4. Whatever still shares a segment across components is compared by bit sketches,
   whose Hamming distance bounds the difference too, and the survivors exactly. Nothing
   is capped: groups beyond ``CHUNK`` sets are dealt to pairs of chunks.

Equal segments of one block of texts meet before the shuffle, and only their first
set goes on to the common pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import arrow_map, components, stored
from postsift.llm.flat import WORD_BASES, Block, blocks, mix, run_hashes, segments, signed, windows

SHINGLE_WORDS = 5
#: Sets of one compared chunk of a large group: bounds the memory of a task, not the result.
CHUNK = 2048
SKETCH_BITS = 1024
#: Pairs whose sets are held at once.
CHECK_ROWS = 64
U64 = np.uint64


def _bounds() -> np.ndarray:
    out = [4]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, dtype=np.int64)


BOUNDS = _bounds()


def shingle_sets(block: Block, size: int = SHINGLE_WORDS, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every row, sorted within the row, and rows + 1 offsets."""
    words = block.word_hashes(lane)
    first, row = windows(block, size)
    value = mix(run_hashes(words, first, first + size, WORD_BASES[0]))
    short = np.flatnonzero((block.counts > 0) & (block.counts < size))
    whole = run_hashes(words, block.word_at[short], block.word_at[short + 1], WORD_BASES[1])
    value = np.concatenate([value, mix(whole + block.counts[short].astype(U64))])
    row = np.concatenate([row, short])
    if len(value) > 16 * block.rows:  # sorting each row by itself is quicker unless rows are tiny
        at = np.searchsorted(row[:len(first)], np.arange(block.rows + 1))
        for s, e in zip(at[:-1], at[1:], strict=True):
            value[s:e].sort()
        order = np.argsort(row, kind="stable")
    else:
        order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(block.rows + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _fingerprint(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _sums(mix(value), at)


def sketch(value: np.ndarray) -> bytes:
    """Parity of the elements at each of a power of two of bits, about as many bits as elements or more."""
    bits = SKETCH_BITS
    while bits < len(value):
        bits *= 2
    odd = np.bincount((value & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc")
        for block in blocks(batch.column("text"), lower=True):
            value, at = shingle_sets(block)
            f1, f2 = _fingerprint(value, at), _fingerprint(*shingle_sets(block, lane=1))
            marks = [sketch(value[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), pa.array(np.diff(at)), pa.array(signed(f1)), pa.array(signed(f2)),
                 pa.array(marks, pa.binary())], names=["doc", "n", "f1", "f2", "sketch"])


def segment_count(band: int) -> int:
    most = 2 * (int(BOUNDS[band + 1]) - 1) // 9
    return most + 1 + max(2, most // 8)


def _band_tokens(value: np.ndarray, at: np.ndarray, rows: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For the given rows: (row, key) of the segments of ``band`` that each row needs."""
    k = segment_count(band)
    n = at[rows + 1] - at[rows]
    partner = np.minimum(n * 5 // 4, BOUNDS[band + 1] - 1)
    need = (n + partner) // 9 + 1
    local = np.repeat(np.arange(len(rows)), n)
    v = value[np.arange(len(local)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[rows], n)]
    v = mix(v ^ mix(np.array([band + 1], dtype=U64)))
    slot = local * k + (((v >> U64(32)) * U64(k)) >> U64(32)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, v = slot[order], v[order]
    cut = segments(slot)
    word = np.bitwise_xor.reduceat(v, cut[:-1])
    count, slot = np.diff(cut), slot[cut[:-1]]
    row = slot // k
    lacking = np.flatnonzero(np.bincount(row, minlength=len(rows)) < need)
    if len(lacking):  # empty segments are segments too, and come last
        grid = (lacking[:, None] * k + np.arange(k)[None, :]).ravel()
        empty = grid[~np.isin(grid, slot)]
        slot, row = np.concatenate([slot, empty]), np.concatenate([row, empty // k])
        word = np.concatenate([word, np.zeros(len(empty), dtype=U64)])
        count = np.concatenate([count, np.zeros(len(empty), dtype=count.dtype)])
    key = mix(word ^ mix((slot % k).astype(U64) | count.astype(U64) << U64(32) | U64(band) << U64(56)))
    order = np.lexsort((key, -count, row))
    row, key = row[order], key[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    taken = rank < need[row]
    return rows[row[taken]], key[taken]


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc"))
        for block in blocks(batch.column("text"), lower=True):
            value, at = shingle_sets(block)
            prints = _fingerprint(value, at)
            n = np.diff(at)
            own = np.searchsorted(BOUNDS, n, side="right") - 1
            found = []
            for band in np.unique(np.concatenate([own, own + 1])):
                rows = np.flatnonzero((own == band) | ((own == band - 1) & (own >= 0) & (n * 5 // 4 >= BOUNDS[band])))
                if band >= 0 and len(rows):
                    found.append(_band_tokens(value, at, rows, int(band)))
            if not found:
                continue
            row, key = (np.concatenate(part) for part in zip(*found, strict=True))
            doc, mark = ids[block.first + row], prints[row]
            order = np.lexsort((doc, mark, key))
            key_s, mark_s = key[order], mark[order]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (key_s[1:] != key_s[:-1]) | (mark_s[1:] != mark_s[:-1])
            order = order[fresh]
            cut = segments(key[order])
            size = np.diff(cut)
            kind = np.full(len(row), -1, dtype=np.int8)
            kind[order] = 2
            kind[order[cut[:-1]]] = np.where(size > 1, 1, 0)
            kept = kind >= 0  # in the order of the texts, which packs well
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key[kept])), pa.array(doc[kept]), pa.array(signed(mark[kept])), pa.array(kind[kept])],
                names=["k", "doc", "f1", "kind"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the segments of more than one set, one document of each; the rows come sorted by kind 2, key, print, document."""
    held = None
    for batch in batches:
        key, doc, mark = (np.asarray(batch.column(c)) for c in ("k", "doc", "f1"))
        kind = np.asarray(batch.column("kind"))
        if held is not None:
            key, doc, mark, kind = (np.append(h, x) for h, x in zip(held[0], (key, doc, mark, kind), strict=True))
        if len(key) == 0:
            continue
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        # another row of the same set says no more, unless it knows of others in its block
        known = kind > 0
        cut = segments(key)
        size = np.diff(cut)
        sets = np.add.reduceat(fresh.astype(np.int64), cut[:-1])
        out = (fresh & np.repeat(sets > 1, size)) | known
        passed = out.copy()
        if held is not None and held[1]:
            out[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(doc[out])], names=["k", "doc"])
        # of an unfinished group only its last row matters: whether a second set follows, and the first one if unsaid
        held = ([key[-1:], doc[-1:], mark[-1:], kind[-1:]], bool(passed[-1]))
        if held[1]:
            held[0][3] = np.array([1], dtype=np.int8)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())],
            names=["doc", "body"])


def _unpacked(bodies: pa.Array) -> list[np.ndarray]:
    """The sets of compressed texts, by the word hashes that candidates are not made from."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = pa.array([unpack(b.as_buffer()) if len(b.as_buffer()) else b"" for b in bodies], pa.large_binary())
    out = []
    for block in blocks(texts.cast(pa.large_string()), lower=True):
        value, at = shingle_sets(block, lane=1)
        out.extend(value[s:e] for s, e in zip(at[:-1], at[1:], strict=True))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that link. Rows of the same first text come together, so its set is made once for a run of them."""
    last, mine = None, None
    for batch in (part for whole in batches for part in pa.Table.from_batches([whole]).to_batches(max_chunksize=CHECK_ROWS)):
        bodies = batch.column("body")
        fresh = [body != before for body, before in zip(bodies, itertools.chain([last], bodies), strict=False)]
        made = iter(_unpacked(bodies.filter(pa.array(fresh, pa.bool_()))))
        keep = []
        for new, b in zip(fresh, _unpacked(batch.column("other")), strict=True):
            mine = next(made) if new else mine
            same = len(np.intersect1d(mine, b, assume_unique=True))
            keep.append(100 * same >= 80 * (len(mine) + len(b) - same) and len(mine) > 0)
        last = bodies[-1] if len(bodies) else last
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link. Texts travel compressed, once for each pair and once for all."""
    bodies = arrow_map(docs, _packed, "doc long, body binary")
    half = pairs.join(bodies.select(F.col("doc").alias("b"), F.col("body").alias("other")), "b")
    both = half.join(bodies.withColumnRenamed("doc", "a"), "a")
    return arrow_map(both.select("a", "b", "body", "other"), _linked, "a long, b long")


def _fold(marks: np.ndarray, length: int) -> np.ndarray:
    while marks.shape[1] > length:
        half = marks.shape[1] // 2
        marks = marks[:, :half] ^ marks[:, half:]
    return marks


def _may_link(one: np.ndarray, two: np.ndarray, elements: int) -> bool:
    bits = min(one.shape[1], two.shape[1])
    return 9 * int(np.bitwise_count(_fold(one, bits) ^ _fold(two, bits)).sum()) <= elements


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches differ in no more places than linked sets can."""
    for batch in batches:
        limit = np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))
        keep = np.zeros(batch.num_rows, dtype=bool)
        pairs = zip(batch.column("sa"), batch.column("sb"), strict=True)
        for i, (one, two) in enumerate(pairs):
            one, two = (np.frombuffer(x.as_buffer(), dtype=np.uint8)[None, :] for x in (one, two))
            keep[i] = _may_link(one, two, limit[i])
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def near_sketches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that sizes and bit sketches allow to link, before any text travels."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.where("n > 0").select(
            F.col("doc").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    fits = pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return arrow_map(fits.select("a", "b", "na", "nb", "sa", "sb"), _close, "a long, b long").distinct()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one (key, chunk pair) whose bit sketches may link and whose components differ; rows come sorted by group."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        new = [pa.Table.from_batches([batch])] if batch is not None else []
        parts = ([held] if held is not None else []) + new
        if sum(part.num_rows for part in parts) == 0:
            continue
        table = pa.concat_tables(parts)
        keys = [np.asarray(table.column(c)) for c in ("k", "c1", "c2")]
        fresh = np.ones(table.num_rows, dtype=bool)
        fresh[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
        starts = np.flatnonzero(fresh)
        whole = table.num_rows if batch is None else int(starts[-1])
        if whole:
            yield _near_groups(table.slice(0, whole), starts[starts < whole])
        held = table.slice(whole)


def _near_groups(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """All groups at once, by distance: every row with the next one of its group, with the one after that, and so on."""
    bounds = np.append(starts, table.num_rows)
    end = np.repeat(bounds[1:], np.diff(bounds))
    n, rep, root, own, c1, c2 = (np.asarray(table.column(c)) for c in ("n", "rep", "root", "c", "c1", "c2"))
    marks = [np.frombuffer(m.as_buffer(), dtype=np.uint8)[None, :] for m in table.column("sketch")]
    # folded to the least length the distance is a bound still
    short = np.concatenate([_fold(m, SKETCH_BITS // 8) for m in marks]).view(U64)
    one, first, second = np.arange(table.num_rows), [], []
    step = 0
    while len(one):
        step += 1
        one = one[one + step < end[one]]
        two = one + step
        fits = (root[one] != root[two]) & ((c1[one] == c2[one]) | (own[one] != own[two]))
        fits &= 5 * np.minimum(n[one], n[two]) >= 4 * np.maximum(n[one], n[two])
        i, j = one[fits], two[fits]
        close = np.bitwise_count(short[i] ^ short[j]).sum(axis=1, dtype=np.int64) * 9 <= n[i] + n[j]
        first.append(i[close])
        second.append(j[close])
    i, j = np.concatenate(first), np.concatenate(second)
    keep = np.ones(len(i), dtype=bool)
    for at in np.flatnonzero(np.minimum(n[i], n[j]) > SKETCH_BITS):
        keep[at] = _may_link(marks[i[at]], marks[j[at]], n[i[at]] + n[j[at]])
    i, j = i[keep], j[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["a", "b"])


def _crossing(groups: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of sets that share a segment, lie in different components and pass the sketch bound."""
    rows = groups.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = (
        rows.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
        .where("low < high").select("k", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")))
    rows = rows.join(mixed, "k").join(sets.select(F.col("doc").alias("rep"), "n", "sketch"), "rep")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "k", F.least("c", "d").alias("c1"), F.greatest("c", "d").alias("c2"), "c", "rep", "root", "n", "sketch")
    return arrow_map(
        rows.repartition("k", "c1", "c2").sortWithinPartitions("k", "c1", "c2"), _near, "a long, b long").distinct()


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Text is lower-cased (A-Z), shingles are five words, a shorter text is one shingle; a text without words has
    0 shingles and is linked with nothing. A null id is never linked and its component is null. Rows that
    share an id are one node: they are each other's component, and each keeps its own number of shingles.
    Other columns are not read. An empty table gives an empty result. Runs jobs when called.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = texts.where("doc is not null")
    sets = stored(
        arrow_map(texts, _summaries, "doc long, n long, f1 long, f2 long, sketch binary"), "sets")
    full = sets.where("n > 0 and doc is not null")
    lead = full.groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep"), F.max("doc").alias("last"))
    copies = full.join(lead.where("rep < last"), ["f1", "f2", "n"]).where("doc > rep").select("doc", "rep").distinct()
    copies = stored(copies, "copies")

    rows = arrow_map(known, _segment_rows, "k long, doc long, f1 long, kind byte")
    shared = arrow_map(
        rows.repartition(F.when(F.col("kind") == 2, F.col("doc")).otherwise(F.col("k")))
        .sortWithinPartitions(F.col("kind") == 2, "k", "f1", "doc"), _shared, "k long, doc long")
    groups = stored(
        shared.join(copies, "doc", "left").select("k", F.coalesce("rep", "doc").alias("rep")).distinct(), "segments")
    lead = groups.groupBy("k").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    pairs = groups.join(lead, "k").where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = verified(near_sketches(pairs, sets), known).unionByName(copies.select(F.col("rep").alias("a"), F.col("doc").alias("b")))
    roots = stored(components(links), "roots")
    more = stored(verified(_crossing(groups, sets, roots), known), "links")
    if not more.isEmpty():
        for side in ("a", "b"):
            more = more.join(roots.withColumnRenamed("id", side), side, "left").withColumn(
                side, F.coalesce("root", side)).drop("root")
        above = stored(components(more), "roots")
        roots = roots.unionByName(above.select("id", F.col("id").alias("root"))).distinct().join(
            above.withColumnRenamed("root", "top").withColumnRenamed("id", "root"), "root", "left").select(
            "id", F.coalesce("top", "root").alias("root")).groupBy("id").agg(F.min("root").alias("root"))
    return sets.join(roots.withColumnRenamed("id", "doc"), "doc", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest id of each component; rows without an id stay.

    Rows that share an id are one document and stay or go together. Only the ids that go are joined.
    """
    found = join_components(docs, id_col, text_col)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
