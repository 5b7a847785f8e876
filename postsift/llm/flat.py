"""Whole batches of texts as flat numpy arrays: words, their hashes and hashes of runs of words.

Everything here works on the UTF-8 bytes of an Arrow column, so no Python string is
made. A word is a run of bytes other than space and ``\\x09``-``\\x0D``. It is hashed
in steps of eight bytes, each mixed into the one before, in two lanes that share no
constant. Runs of words are polynomials over mixed word hashes modulo 2**64, taken from
prefix sums, so any run costs one subtraction and one product, wherever it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BYTE_BASE = 0x9E3779B97F4A7C15
#: Start and multiplier of the two lanes of word hashes.
LANES = ((0x9E3779B97F4A7C15, 0x2127599BF4325C37), (0x6A09E667F3BCC909, 0x880355F21E6D1965))
#: A longer word is digested as a whole.
STEPPED_BYTES = 1024
WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i`` in ``range(n)``; kept while short."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        got = np.full(size, base, dtype=U64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[base] = got
    return got


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of ``values[s:e]`` for each start and end."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * powers(base, n + 1)[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(inverse(base), n + 1)[starts]


@dataclass
class Block:
    """Some rows of a batch: ``first`` row, and for each row where its words begin in the flat arrays."""

    first: int
    rows: int
    data: np.ndarray      # the bytes of all texts, one after the other
    text_at: np.ndarray   # rows + 1 offsets into data
    starts: np.ndarray    # words: first byte
    ends: np.ndarray      # words: byte after the last
    word_at: np.ndarray   # rows + 1 offsets into starts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def word_hashes(self, lane: int = 0) -> np.ndarray:
        """64 bits for each word; the two lanes are independent of each other."""
        start, factor = (U64(x) for x in LANES[lane])
        left = self.ends - self.starts
        out = mix(left.astype(U64) + start)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eights = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded.data, strides=(1,))
        long = np.flatnonzero(left > STEPPED_BYTES)
        for i in long:
            digest = hashlib.blake2b(self.data[self.starts[i]: self.ends[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * lane: 8 * lane + 8], "little")
        if len(long):
            todo = np.flatnonzero(left <= STEPPED_BYTES)
            at, left, now = self.starts[todo], left[todo], out[todo]
        else:
            todo, at, now = None, self.starts, out
        while len(at):
            now = mix((now ^ (eights[at] & _LOW_BYTES[np.minimum(left, 8)])) * factor)
            if todo is None:
                out = now
            else:
                out[todo] = now
            more = np.flatnonzero(left > 8)
            todo = more if todo is None else todo[more]
            at, left, now = at[more] + 8, left[more] - 8, now[more]
        return out


def byte_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into blocks: the first row, all bytes, rows + 1 offsets into them. Null is the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def blocks(
    texts: pa.Array, lower: bool = False, block_bytes: int = BLOCK_BYTES, outside: np.ndarray = SPACE,
) -> Iterator[Block]:
    """Cut a column of texts into blocks of rows and find their words; null counts as the empty text.

    ``outside`` says of each byte whether it is between words, ``lower`` lower-cases A-Z.
    """
    for first, data, at in byte_blocks(texts, block_bytes):
        yield _words(first, LOWER[data] if lower else data, at, outside)


def _words(first: int, data: np.ndarray, at: np.ndarray, outside: np.ndarray) -> Block:
    inside = ~outside[data]
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | breaks[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | breaks[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Block(first, len(at) - 1, data, at, starts, ends, np.searchsorted(starts, at))


def windows(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every run of ``size`` words inside one text, and its row."""
    rows = block.row_of_word()
    index = np.arange(len(rows))
    fits = index + size <= block.word_at[1:][rows]
    return index[fits], rows[fits]


def segments(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array, with its length at the end."""
    if len(values) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
