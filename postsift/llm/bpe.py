"""Byte-pair merging over a heap of ranks and a linked list of symbols, for tokenizer files in JSON.

A word's symbols stand in a doubly linked list. Every adjacent pair with a rank waits
in a heap; the lowest rank is popped, its two symbols become one, and the pairs with
the new neighbours are pushed. Entries whose symbols have changed meanwhile are stale
and are skipped. Counting needs the number of merges only; encoding reads the list.

Texts hold few distinct words, so the work for a word is done once per task and kept
in a memo of bounded size.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

#: White_Space of Unicode, as the tokenizers' patterns mean it.
_WS = r"\t-\r \x85\xa0  -     　"
#: The two splitting rules of the tokenizer files.
BYTE_LEVEL_SPLIT = regex.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
WORD_SPLIT = regex.compile(rf"'(?:[stmd]|re|ve|ll)|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
WHITE = regex.compile(rf"[{_WS}]+")
#: White space before a space: there, cutting at spaces would move a boundary.
_UNEVEN_ASCII = [chr(c) + " " for c in (*range(9, 14), *range(28, 33))]
_UNEVEN = [*_UNEVEN_ASCII, *(
    chr(c) + " " for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]

_SHIFT = 17
_AT = 40
_AT_MASK = (1 << _AT) - 1
#: Entries of one generation of a memo, and the longest text that is kept.
MEMO_ENTRIES = 250_000
MEMO_CHARS = 64


class Memo(dict):
    """``make(key)`` for each key asked for, kept in two generations so that frequent keys stay."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Merger:
    """The vocabulary and the merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(self.vocab[left] << _SHIFT | self.vocab[right], rank)
            self.merged.append(self.vocab[left + right])
        letters = byte_alphabet()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.special_split = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")")

    def merge(self, word: bytes) -> tuple[list[int], list[int], int]:
        """The symbols after all merges (-1: merged away), the next-links and the number of merges."""
        symbols = [self.inner[b] for b in word]
        n = len(symbols)
        if n and self.suffix:
            symbols[-1] = self.last[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = []
        for i in range(n - 1):
            r = rank(symbols[i] << _SHIFT | symbols[i + 1])
            if r is not None:
                heap.append(r << _AT | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        merges = 0
        while heap:
            item = pop(heap)
            r, i = item >> _AT, item & _AT_MASK
            j = after[i]
            if symbols[i] < 0 or j >= n or rank(symbols[i] << _SHIFT | symbols[j]) != r:
                continue
            merges += 1
            new = self.merged[r]
            symbols[i], symbols[j] = new, -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                r = rank(new << _SHIFT | symbols[k])
                if r is not None:
                    push(heap, r << _AT | i)
            if h >= 0:
                r = rank(symbols[h] << _SHIFT | new)
                if r is not None:
                    push(heap, r << _AT | h)
        return symbols, after, merges

    def count(self, word: bytes) -> int:
        return len(word) - self.merge(word)[2] if len(word) > 1 else len(word)

    def encode(self, word: bytes) -> list[int]:
        """The ids left in the list."""
        symbols, after, _ = self.merge(word)
        out, i = [], 0
        while i < len(symbols):
            out.append(symbols[i])
            i = after[i]
        return out


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def byte_level_words(text: str) -> list[str]:
    return BYTE_LEVEL_SPLIT.findall(text)


def spaced_parts(text: str) -> Iterator[tuple[str, list[str]]]:
    """Cut a text of the byte-level rule at single spaces: a first part, and parts that each follow a space.

    No word of the rule crosses such a cut, unless white space stands before the
    space; a text with such a place comes back whole, as a first part.
    """
    if any(map(text.__contains__, _UNEVEN_ASCII if text.isascii() else _UNEVEN)):
        yield text, []
    else:
        first, *rest = text.split(" ")
        yield first, rest


def simple_lower(text: str) -> str:
    """Lower case, character by character: a final sigma is not treated specially."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def normal_words(chunk: str) -> list[str]:
    """The words of a text for the word-end rule: composed (NFC), lower case, white space dropped."""
    return WORD_SPLIT.findall(simple_lower(WHITE.sub(" ", unicodedata.normalize("NFC", chunk))))
