"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into pieces of ``PIECE`` to twice as many bytes (shorter items are one piece), and once more into
overlapping pieces of ``WINDOW`` bytes, ``STRIDE`` apart, the last one at the item's end. With that stride any ``WINDOW``
consecutive bytes of an item are within the edits allowed to one of them, wherever a copy begins. A text holds a piece
if some region of it is within ``RATE`` of the piece's length in edits. Such a region shares at least
m + 1 - q (e + 1) of its q-grams with the piece, at places whose differences (diagonals) lie within e + 1 of each other:

1. q-grams of the texts that the pieces have are found, by hash.
2. They are counted per piece in bands of 2 (e + 1) diagonals that overlap by half, so that any e + 1 neighbouring diagonals
   lie in one band. Bands below the bound cannot hold a match and drop out.
3. What is left is verified by an alignment inside the band.

Memory does not follow the number of shared q-grams: a text is read in stretches, shared q-grams are counted in rounds of
``ROUND``, and a band that no later place can reach is decided and dropped. A q-gram that stands many times in one piece is
counted by bands made ready for each remainder of its place, so a text of one letter against an item of that letter
costs bands and not pairs of places.

Texts are compared as UTF-8 bytes, all letters case-folded and every run of white space one blank. Items under ``Q`` bytes
are found where they stand unchanged as whole words. The texts are not
shuffled: items go to the tasks in blocks of ``BLOCK`` bytes, one pass for each block, however large the benchmark is.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import arrow_map
from postsift.llm.flat import BYTE_BASE, U64, byte_blocks, inverse, mix, powers, segments

Q = 10
PIECE = 100
RATE = 0.08
#: The overlapping pieces; their stride leaves no start further from one than the edits it may have.
WINDOW = 80
STRIDE = 2 * int(WINDOW * RATE) + 1
#: Bytes of benchmark text that one pass over the texts carries.
BLOCK = 1 << 20
#: Places of a text looked up at once, shared q-grams counted at once, bands aligned at once.
STRETCH = 1 << 20
ROUND = 1 << 21
ALIGNED = 1 << 15
#: A q-gram as often in one piece is counted by bands made ready.
DENSE = 16
_FILTER_BITS = 20
_COST = 1 << 20
#: Above the half width of any band.
_MOST_STEP = 1 << 10

#: No letter beyond has capitals, and no white space; the letters there are written without blanks.
_LAST = 0x20000
_UNSPACED = ((0xE00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00))

Item = tuple[int | None, bytes]  # number, normal bytes
Piece = tuple[int | None, int, bytes]  # item, offset in it, bytes


class Normal(NamedTuple):
    """Texts in normal form: their bytes, where each text begins, and for each byte its code point in the text as it was."""

    data: np.ndarray
    at: np.ndarray
    point: np.ndarray
    joined: np.ndarray  # whether a byte continues the word of the one before


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, dict[int, str], np.ndarray, np.ndarray]:
    """Case folding of code points, to one (white space to a blank) and to several; white space; letters of spaced words."""
    fold, several = np.arange(_LAST, dtype="<u4"), {}
    blank, word = np.zeros(_LAST, dtype=bool), np.zeros(_LAST, dtype=bool)
    for i in range(_LAST):
        c = chr(i)
        blank[i], word[i] = c.isspace(), c.isalnum() or c == "_" or category(c)[0] == "M"
        folded = c.casefold()
        if len(folded) == 1:
            fold[i] = ord(folded)
        else:
            several[i] = folded
    fold[blank] = 32
    for low, high in _UNSPACED:
        word[low:high] = False
    return fold, several, blank, word


def normalized(data: np.ndarray, at: np.ndarray) -> Normal:
    """The normal form of texts that stand one after the other in UTF-8, ``at`` their offsets."""
    fold, several, blank, word = _tables()
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    first = np.searchsorted(lead, at)
    low = np.where(points < _LAST, points, 0)
    space = blank[low]
    out = np.where(points < _LAST, fold[low], points)
    # of a run of white space in a text only the first one stays
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[first[:-1][first[:-1] < len(points)]] = True
    lengths = keep.astype(np.int64)
    special = np.flatnonzero(np.isin(points, list(several))) if len(data) > len(points) else np.zeros(0, dtype=np.int64)
    lengths[special] = [len(several[int(points[i])]) for i in special]
    source = np.repeat(np.arange(len(points)), lengths)
    to = np.concatenate([[0], np.cumsum(lengths)])
    out = out[source]
    for i in special:
        out[to[i]: to[i + 1]] = [ord(c) for c in several[int(points[i])]]
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    begin = np.concatenate([[0], np.cumsum(width)])
    letter = word[np.where(out < _LAST, out, 0)]
    joined = np.ones(begin[-1], dtype=bool)
    joined[begin[:-1]] = letter & np.concatenate([[False], letter[:-1]])
    new_at = begin[to[first]]
    joined[new_at[new_at < len(joined)]] = False
    offset = np.repeat(first[:-1], np.diff(first))
    point = np.repeat((np.arange(len(points)) - offset)[source], width)
    return Normal(np.frombuffer(out.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8), new_at, point, joined)


def normal(data: np.ndarray) -> np.ndarray:
    """The bytes of one text in normal form."""
    return normalized(data, np.array([0, len(data)])).data


def _item_bytes(text: str | None) -> bytes:
    return normal(np.frombuffer((text or "").encode(), dtype=np.uint8)).tobytes().strip()


def _cuts(n: int, size: int = PIECE) -> list[tuple[int, int]]:
    """Where the disjoint pieces of an item of ``n`` bytes begin and end."""
    parts = max(1, n // size)
    cuts = [n * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _windows(n: int) -> list[tuple[int, int]]:
    """Where its overlapping pieces begin and end; none where the item is not longer than one."""
    return [(a, a + WINDOW) for a in [*range(0, n - WINDOW, STRIDE), n - WINDOW]] if n > WINDOW else []


def pieces_of(item: int | None, text: str | None, size: int = PIECE) -> list[Piece]:
    """Pieces of an item of at least ``Q`` bytes; a shorter one (or null) gives none, it is found as it is."""
    raw = _item_bytes(text)
    if len(raw) < Q:
        return []
    return [(item, a, raw[a:b]) for a, b in [*_cuts(len(raw), size), *_windows(len(raw))]]


def _gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(data)
    if n < q:
        return np.zeros(0, dtype=U64)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BYTE_BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * powers(inverse(BYTE_BASE), n + 1)[: n - q + 1])


def _ranges(lows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``low, low + 1, ...``, ``count`` values for each low."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lows, counts)


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of the weights of each."""
    if len(codes) == 0:
        return codes, weights
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = segments(codes)[:-1]
    return codes[first], np.add.reduceat(weights[order], first)


class Text(NamedTuple):
    """One text in normal form as alignments read it: its bytes, and the same between margins that equal no byte."""

    raw: bytes
    padded: np.ndarray
    margin: int


class Index:
    """The q-grams of some items, by hash, and the pieces that each of them is in."""

    def __init__(self, items: tuple[Item, ...]):
        self.items = items
        self.body = b"".join(raw for _, raw in items)
        self.item_at = np.cumsum([0, *(len(raw) for _, raw in items)])
        kinds = []
        for cut in (_cuts, _windows):
            # pieces of an item with the same bytes are one
            firsts: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            for i, (_, raw) in enumerate(items):
                for a, b in cut(len(raw)) if len(raw) >= Q else ():
                    firsts.setdefault((i, raw[a:b]), (i, a, b))
            kinds.append(list(firsts.values()))
        table = np.array([row for kind in kinds for row in kind], dtype=np.int64).reshape(-1, 3)
        self.owner = table[:, 0]
        self.start, self.end = self.item_at[self.owner] + table[:, 1], self.item_at[self.owner] + table[:, 2]
        self.length = self.end - self.start
        # fewer edits where the lemma would ask for no shared q-gram at all
        self.edits = np.minimum((self.length * RATE).astype(np.int64), np.maximum(self.length // Q - 1, 0))
        self.need = self.length + 1 - Q * (self.edits + 1)
        hashes = _gram_hashes(np.frombuffer(self.body, dtype=np.uint8))
        place = np.arange(len(hashes))
        place = place[place + Q <= self.item_at[np.searchsorted(self.item_at, place, side="right")]]
        place = place[np.argsort(hashes[place], kind="stable")]
        self.place = place
        self.hashes, first = np.unique(hashes[place], return_index=True)
        self.at = np.append(first, len(place))
        # pieces of a kind begin and end in order: those that hold a q-gram are neighbours
        self.holders, begin = [], 0
        for kind in kinds:
            part = slice(begin, begin + len(kind))
            low = np.searchsorted(self.end[part], place + Q) + begin
            self.holders.append((low, np.searchsorted(self.start[part], place, side="right") + begin - low))
            begin += len(kind)
        held = np.concatenate([[0], np.cumsum(self.holders[0][1] + self.holders[1][1])])
        #: how many rows a q-gram adds to the count, wherever it stands in a text
        self.weight = held[self.at[1:]] - held[self.at[:-1]]
        self._make_dense()
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.hashes >> U64(64 - _FILTER_BITS)] = True
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, (_, raw) in enumerate(items):
            if len(raw) < Q:
                self.short.setdefault(len(raw), {}).setdefault(raw, []).append(i)

    def bytes_of(self, piece: int) -> bytes:
        return self.body[self.start[piece]: self.end[piece]]

    def _entries(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For q-grams (numbers, may repeat): (which of them, piece, offset in the piece) wherever they stand in a piece."""
        times = self.at[grams + 1] - self.at[grams]
        entry = _ranges(self.at[grams], times)
        source = np.repeat(np.arange(len(grams)), times)
        lows, counts = (np.concatenate([held[i][entry] for held in self.holders]) for i in (0, 1))
        piece = _ranges(lows, counts)
        source, place = (np.repeat(np.tile(x, len(self.holders)), counts) for x in (source, self.place[entry]))
        return source, piece, place - self.start[piece]

    def _make_dense(self) -> None:
        """For q-grams that stand ``DENSE`` times or more in one piece: their pieces, and for each remainder of a place
        modulo the half width of the piece's bands the bands below the place's own, with counts."""
        n = len(self.hashes)
        self.dense, pieces, remainders, lows, counts = np.zeros(n, dtype=bool), [], [], [], []
        owners: list[np.ndarray] = []
        often = np.flatnonzero(np.diff(self.at) >= DENSE)
        cut = np.cumsum(self.weight[often]) // ROUND
        for grams in np.split(often, np.flatnonzero(np.diff(cut)) + 1) if len(often) else []:
            source, piece, offset = self._entries(grams)
            pair, times = np.unique(source * len(self.start) + piece, return_counts=True)
            heavy = np.zeros(len(grams), dtype=bool)
            heavy[pair[times >= DENSE] // len(self.start)] = True
            self.dense[grams[heavy]] = True
            picked = heavy[source]
            source, piece, offset = source[picked], piece[picked], offset[picked]
            pair = pair[heavy[pair // len(self.start)]]
            owners.append(grams[pair // len(self.start)])
            pieces.append(pair % len(self.start))
            pair_at = np.searchsorted(pair, source * len(self.start) + piece)
            step = self.edits[piece] + 1
            widest = int(step.max(initial=1))
            span = int(self.length.max(initial=1)) + 2
            rows, row_counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for r in range(widest):
                has = step > r
                code = (pair_at[has] * widest + r) * span - (r - offset[has]) // step[has]
                code, count = np.unique(code, return_counts=True)
                rows, row_counts = np.concatenate([rows, code]), np.concatenate([row_counts, count])
            order = np.argsort(rows)
            rows, base = rows[order], sum(len(x) for x in pieces[:-1])
            remainders.append((rows // span // widest + base) * _MOST_STEP + rows // span % widest)
            lows.append(-(rows % span))
            counts.append(row_counts[order])
        empty = [np.zeros(0, dtype=np.int64)]
        self.dense_piece, owner = np.concatenate(pieces or empty), np.concatenate(owners or empty)
        self.dense_at = np.searchsorted(owner, np.arange(n + 1))
        self.row_key = np.concatenate(remainders or empty)
        self.row_low, self.row_count = np.concatenate(lows or empty), np.concatenate(counts or empty)
        # a q-gram made ready adds as many rows as the fullest of its remainders, about
        per = np.bincount(self.row_key // _MOST_STEP, minlength=len(self.dense_piece)) // (self.edits[self.dense_piece] + 1) + 1
        total = np.concatenate([[0], np.cumsum(per)])
        self.weight = np.where(self.dense, total[self.dense_at[1:]] - total[self.dense_at[:-1]], self.weight)

    def _counted(self, place: np.ndarray, text: np.ndarray, gram: np.ndarray, low: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (text, piece, band) of shared q-grams, distinct, and how many share each; ``place`` is inside the text."""
        dense = self.dense[gram]
        source, piece, offset = self._entries(gram[~dense])
        at, owner = place[~dense][source], text[~dense][source]
        codes = (owner * len(self.start) + piece) * span + (at - offset) // (self.edits[piece] + 1) - low
        weights = np.ones(len(codes), dtype=np.int64)
        if dense.any():
            place, text, gram = place[dense], text[dense], gram[dense]
            times = self.dense_at[gram + 1] - self.dense_at[gram]
            pair = _ranges(self.dense_at[gram], times)
            place, text, piece = np.repeat(place, times), np.repeat(text, times), self.dense_piece[pair]
            step = self.edits[piece] + 1
            key = pair * _MOST_STEP + place % step
            first = np.searchsorted(self.row_key, key)
            times = np.searchsorted(self.row_key, key, side="right") - first
            row = _ranges(first, times)
            base = (text * len(self.start) + piece) * span + place // step - low
            codes = np.concatenate([codes, np.repeat(base, times) + self.row_low[row]])
            weights = np.concatenate([weights, self.row_count[row]])
        return _summed(codes, weights)

    def _hits(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in all bytes, text, q-gram) of the q-grams that some piece has, by place, in rounds."""
        for begin in range(0, max(0, len(data) - Q + 1), STRETCH):
            grams = _gram_hashes(data[begin: begin + STRETCH + Q - 1])
            where = np.flatnonzero(self.filter[grams >> U64(64 - _FILTER_BITS)])
            found = np.searchsorted(self.hashes, grams[where])
            ok = found < len(self.hashes)
            ok[ok] = self.hashes[found[ok]] == grams[where[ok]]
            where, found = where[ok] + begin, found[ok]
            text = np.searchsorted(at, where, side="right") - 1
            inside = where + Q <= at[text + 1]
            where, found, text = where[inside], found[inside], text[inside]
            if len(where):
                cut = np.flatnonzero(np.diff(np.cumsum(self.weight[found]) // ROUND)) + 1
                yield from zip(*(np.split(x, cut) for x in (where, text, found)), strict=True)

    def candidates(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows (text, piece, first diagonal of the band), in order, of the bands that share enough q-grams."""
        pieces, longest = len(self.start), int(self.length.max(initial=0))
        low, span = -longest - 2, int(np.diff(at).max(initial=0)) + longest + 4
        codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found = [codes]
        for where, text, gram in self._hits(data, at):
            new = self._counted(where - at[text], text, gram, low, span)
            codes, counts = _summed(np.concatenate([codes, new[0]]), np.concatenate([counts, new[1]]))
            double, count = _summed(np.concatenate([codes, codes - 1]), np.concatenate([counts, counts]))
            found.append(double[count >= self.need[double // span % pieces]])
            # a row stays while its band or the next one may still grow
            piece = codes // span % pieces
            end = (codes % span + low + 2) * (self.edits[piece] + 1) + self.length[piece]
            stays = (codes // span // pieces == text[-1]) & (end >= where[-1] - at[text[-1]])
            codes, counts = codes[stays], counts[stays]
        passed = np.unique(np.concatenate(found))
        piece = passed // span % pieces if pieces else passed
        return np.stack([passed // span // max(pieces, 1), piece, (passed % span + low) * (self.edits[piece] + 1)], axis=1)

    def text_of(self, data: np.ndarray) -> Text:
        margin = 5 * int(self.length.max(initial=0)) + 8
        edge = np.full(margin, -1, np.int16)
        return Text(data.tobytes(), np.concatenate([edge, data, edge], dtype=np.int16), margin)

    def aligned(self, piece: int, text: Text, diagonals: np.ndarray) -> np.ndarray:
        """For bands that begin at ``diagonals`` of one text: the best regions within the budget, distinct rows
        (edits, start, end) in order."""
        parts = [self._aligned(piece, text, diagonals[i: i + ALIGNED]) for i in range(0, len(diagonals), ALIGNED)]
        return np.unique(np.concatenate(parts), axis=0)

    def _aligned(self, piece: int, text: Text, diagonals: np.ndarray) -> np.ndarray:
        whole = self.bytes_of(piece)
        body = np.frombuffer(whole, dtype=np.uint8).astype(np.int16)
        edits, m, size = int(self.edits[piece]), len(body), len(text.raw)
        width = 2 * (edits + 1) + 2 * edits
        low = diagonals - edits
        out, rest = [], []
        for d in low.tolist():
            place = text.raw.find(whole, max(0, d), max(0, d + width + m))
            if place >= 0:
                out.append((0, place, place + m))
            elif edits:
                rest.append(d)
        exact = np.array(out, dtype=np.int64).reshape(-1, 3)
        if not rest:
            return exact
        # cells are diagonals; a cell holds the cost, then where its alignment began
        low = np.array(rest)
        column = np.arange(width)
        offset = np.clip(low, -(width + m), size) + text.margin
        cost = np.tile(column, (len(rest), 1)).astype(np.int64)
        rise = column.astype(np.int64) * _COST
        for i in range(m):
            seen = text.padded[np.minimum(offset[:, None] + i + column[None, :], len(text.padded) - 1)]
            base = cost + np.where(seen == body[i], 0, _COST)
            base[:, :-1] = np.minimum(base[:, :-1], cost[:, 1:] + _COST)
            cost = np.minimum.accumulate(base - rise, axis=1) + rise
        best = cost.argmin(axis=1)
        value = cost[np.arange(len(rest)), best]
        start, end = np.maximum(low + value % _COST, 0), np.minimum(low + best + m, size)
        near = np.stack([value // _COST, start, end], axis=1)[value // _COST <= edits]
        return np.concatenate([exact, near])

    def short_matches(self, texts: Normal) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of the items under ``Q`` bytes that stand in a text as whole words."""
        data, at, _, joined = texts
        edge = np.append(~joined, True)
        for size, items in self.short.items():
            wanted = np.sort(np.concatenate([_gram_hashes(np.frombuffer(raw, dtype=np.uint8), size) for raw in items]))
            place = np.flatnonzero(edge[: max(0, len(data) - size + 1)] & edge[size:])
            hashes = _gram_hashes(data, size)[place]
            found = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            place = place[wanted[found] == hashes]
            text = np.searchsorted(at, place, side="right") - 1
            for row, a in zip(text.tolist(), place.tolist(), strict=True):
                if a + size <= at[row + 1]:
                    for item in items.get(data[a: a + size].tobytes(), ()):
                        yield row, item, a - int(at[row]), a - int(at[row]) + size

    def matches(self, texts: Normal) -> dict[int, list[tuple[int, int, int, int]]]:
        """By text: (place in the index, edits, start, end) of regions, byte offsets in the text.

        Regions of one item that overlap or touch are one, with the least edits of its pieces.
        """
        parts: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        data, at, _, _ = texts
        for text, item, s, e in self.short_matches(texts):
            parts.setdefault((text, item), []).append((s, e, 0, int(self.item_at[item])))
        rows = self.candidates(data, at)
        cut = np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0), axis=1)) + 1 if len(rows) else []
        last, body = -1, None
        for group in np.split(rows, cut) if len(rows) else []:
            text, piece = int(group[0, 0]), int(group[0, 1])
            if text != last:
                last, body = text, self.text_of(data[at[text]: at[text + 1]])
            # the best first; a region that overlaps a better one goes
            kept: list[tuple[int, int, int]] = []
            for n, a, b in self.aligned(piece, body, group[:, 2]).tolist():
                i = bisect(kept, (a, b, n))
                if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or b <= kept[i][0]):
                    kept.insert(i, (a, b, n))
            parts.setdefault((text, int(self.owner[piece])), []).extend((s, e, n, int(self.start[piece])) for s, e, n in kept)
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for (text, _), regions in parts.items():
            end = -1
            for s, e, n, place in sorted(regions):
                if s > end:
                    found.setdefault(text, []).append((place, n, s, e))
                else:
                    place, least, first, _ = found[text][-1]
                    found[text][-1] = (place, min(n, least), first, max(e, end))
                end = max(e, end)
        return found


@lru_cache(maxsize=4)
def _index(items: tuple[Item, ...]) -> Index:
    return Index(items)


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[tuple[Item, ...]]:
    items, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).distinct()
    for row in rows.orderBy("item", "text").toLocalIterator():
        raw = _item_bytes(row.text)
        # a sign alone is in every text
        if len(raw) < Q and not any(c.isalnum() for c in raw.decode()):
            continue
        items.append((row.item, raw))
        size += len(raw)
        if size >= block:
            yield tuple(items)
            items, size = [], 0
    if items:
        yield tuple(items)


_KIND = "array<struct<item:bigint,piece_start:bigint,edits:bigint,start:bigint,end:bigint>>"


def with_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    to_col: str = "matches", block: int = BLOCK,
) -> DataFrame:
    """``docs`` with ``to_col`` added (or replaced): the parts of benchmark items found in each text.

    An entry is a region of the text: the item, where the first piece found there begins in it (bytes of its normal form), the least edits of
    a piece, and the region in the text (code points, end exclusive). Regions of an item that overlap are one. Null and empty texts match nothing; null items and those without a letter or digit under ``Q`` bytes are not looked for;
    repeated items count once.
    An empty benchmark finds nothing.
    """
    names = [c for c in docs.columns if c != to_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != to_col)
    out = docs.select(*names).withColumn(to_col, F.array().cast(_KIND))
    shared_context = docs.sparkSession.sparkContext
    for items in _item_blocks(benchmark, item_col, item_text_col, block):
        shared = shared_context.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for batch in batches:
                lists = batch.column(to_col).to_pylist()
                at_text = batch.schema.names.index(text_col)
                for first, raw, at in byte_blocks(batch.column(at_text)):
                    texts = normalized(raw, at)
                    for row, found in index.matches(texts).items():
                        points = texts.point[texts.at[row]: texts.at[row + 1]]
                        for place, edits, s, e in found:
                            owner = int(np.searchsorted(index.item_at, place, side="right")) - 1
                            item, place = index.items[owner][0], place - int(index.item_at[owner])
                            lists[first + row].append({
                                "item": item, "piece_start": place, "edits": edits,
                                "start": int(points[s]), "end": int(points[e - 1]) + 1})
                kind = batch.schema.field(to_col).type
                arrays = list(batch.columns)
                arrays[batch.schema.names.index(to_col)] = pa.array(lists, kind)
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

        out = arrow_map(out, run, f"{fields}, `{to_col}` {_KIND}")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """One row for each text and item found in it: id, ``item_id``, ``n_regions``, the least ``edits``, and the first region."""
    rows = with_matches(docs.select(id_col, text_col), benchmark, text_col, **names)
    flat = rows.where(F.size("matches") > 0).select(id_col, F.xxhash64(text_col).alias("_tag"), F.explode("matches").alias("m"))
    return flat.groupBy(id_col, "_tag", F.col("m.item").alias("item_id")).agg(
        F.count("*").alias("n_regions"), F.min("m.edits").alias("edits"), F.min("m.start").alias("start"),
        F.min_by("m.end", "m.start").alias("end")).drop("_tag")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no piece of the benchmark. Nothing is shuffled."""
    rows = with_matches(docs, benchmark, text_col, to_col="_matches", **names)
    return rows.where(F.size("_matches") == 0).drop("_matches")
