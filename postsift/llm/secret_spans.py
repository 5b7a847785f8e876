"""Secret scans: fixed patterns, and a linear-chain conditional random field over words.

Words are tagged as begin, inside or outside of a secret. The score of a tag adds weights of the word's shape (length,
digits, changes of character class, punctuation, capitals), of the word itself, of the shapes and words beside it, and of
the document (its length and share of digits), and weights of pairs of tags; the best tagging of a text is found by
Viterbi's method.

Nearly all words are plainly outside. A secret can only stand where some run of words gains over tagging it outside, and
the runs that might are found for a block of texts at once by prefix sums of an upper bound; Viterbi runs on these alone
and still gives the best tagging of the whole text.

The field is fitted by maximum likelihood on a bounded sample of texts whose pattern matches are the tags.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import arrow_map, stored
from postsift.llm.flat import Block, blocks
from postsift.llm.sampling import fetched, picked_rows

#: The patterns, and what a match must have to count.
KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
ASSIGN_STEMS = (b"password", b"passwd", b"secret", b"token", b"api")

O, B, I = range(3)
SHAPES, WORDS, PLACES = 1024, 1024, 32
TABLES = (SHAPES, WORDS, WORDS, WORDS, SHAPES, SHAPES, PLACES)
#: The bounded sample: texts, windows of each, words of a window; and the fitting.
SAMPLE_DOCS, WINDOWS_PER_DOC, WINDOW = 4000, 4, 24
STEPS, RATE, PENALTY = 60, 0.5, 0.002


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns, (start, end, kind) in code points, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    # a run of hexadecimal digits is matched from its first one, so the length can be asked for at once
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _may_match(block: Block) -> np.ndarray:
    """Rows that can have a match at all: they hold a stem of a pattern or a long run of hexadecimal digits."""
    data = block.data
    digits = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    out = np.zeros(block.rows, dtype=bool)
    if len(data) >= HEX_LENGTH:
        runs = np.concatenate([[0], np.cumsum(digits, dtype=np.int64)])
        ends = np.flatnonzero(runs[HEX_LENGTH:] - runs[:-HEX_LENGTH] == HEX_LENGTH)
        out[np.searchsorted(block.text_at, ends, side="right") - 1] = True
    raw = data.tobytes()
    low = raw.lower()
    for body, stems in ((low, ASSIGN_STEMS), (raw, (b"AKIA",))):
        for stem in stems:
            at = body.find(stem)
            while at >= 0:
                row = int(np.searchsorted(block.text_at, at, side="right")) - 1
                out[row] = True
                at = body.find(stem, int(block.text_at[row + 1]))
    return out


def _bucket(value: np.ndarray, edges: list) -> np.ndarray:
    return np.searchsorted(np.array(edges), value, side="right")


def word_features(block: Block) -> np.ndarray:
    """For every word the row to take from each weight table (``TABLES``)."""
    data, s, e = block.data, block.starts, block.ends
    kind = np.full(256, 3, dtype=np.int8)  # lower, upper, digit, other, beyond ASCII
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 4
    cls = kind[data]

    def count(mask: np.ndarray, start: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[e] - total[start]

    length = e - s
    digits, upper, other = count(cls == 2, s), count(cls == 1, s), count(cls == 3, s)
    change = np.zeros(len(data), dtype=bool)
    change[1:] = cls[1:] != cls[:-1]
    changes = count(change, s + 1)
    shape = _bucket(length, [3, 6, 10, 16, 24, 32, 48])
    shape = shape * 4 + _bucket(digits / np.maximum(length, 1), [0.01, 0.2, 0.8])
    shape = shape * 4 + _bucket(changes / np.maximum(length, 1), [0.15, 0.3, 0.6])
    shape = shape * 4 + np.where(other == 0, 0, np.where(other == length, 3, np.where(other <= 2, 1, 2)))
    shape = shape * 2 + (upper > 1)
    word = (block.word_hashes() & np.uint64(WORDS - 1)).astype(np.int64)
    row = block.row_of_word()
    n = block.counts
    share = np.add.reduceat(np.append(digits, 0), block.word_at[:-1]) * (n > 0) / np.maximum(n, 1) if len(n) else np.zeros(0)
    place = (_bucket(n, [20, 50, 100, 300, 1000, 3000, 10000]) * 4 + _bucket(share, [0.02, 0.1, 0.5]))[row]
    same = np.zeros(len(s) + 1, dtype=bool)  # whether a word and the one before are of one text
    same[1:-1] = row[1:] == row[:-1]

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if by < 0:
            out[1:] = np.where(same[1:-1], x[:-1], 0)
        else:
            out[:-1] = np.where(same[1:-1], x[1:], 0)
        return out

    return np.stack(
        [shape, word, shifted(word, -1), shifted(word, 1), shifted(shape, -1), shifted(shape, 1), place], axis=1).astype(np.int32)


@dataclass(frozen=True)
class Field:
    """Weights of the tags: one table for each feature, and of pairs of tags (outside to inside is impossible)."""

    tables: tuple[np.ndarray, ...]
    pairs: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(table[features[:, k]] for k, table in enumerate(self.tables))


_NEVER = -1e9


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def learn(features: np.ndarray, tags: np.ndarray, known: np.ndarray) -> Field:
    """Maximum likelihood over windows: features (n, w, k), tags (n, w), known (n, w) is false behind a window's end."""
    n, w, k = features.shape
    sizes = np.concatenate([[0], np.cumsum(TABLES)])
    flat = features + sizes[:-1][None, None, :]
    weights, pairs = np.zeros((sizes[-1], 3)), np.zeros((3, 3))
    pairs[O, I] = _NEVER
    grown, grown_pairs = np.full_like(weights, 1e-8), np.full_like(pairs, 1e-8)
    hot = np.eye(3)[tags] * known[..., None]
    both = known[:, 1:] & known[:, :-1]
    seen_pairs = np.einsum("nwa,nwb->ab", hot[:, :-1] * both[..., None], hot[:, 1:])
    for _ in range(STEPS):
        emit = weights[flat].sum(axis=2)
        emit[:, 0, I] = _NEVER
        ahead, back = np.zeros((n, w, 3)), np.zeros((n, w, 3))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, w):
            step = _log_sum(ahead[:, t - 1, :, None] + pairs, 1) + emit[:, t]
            ahead[:, t] = np.where(known[:, t, None], step, ahead[:, t - 1])
        for t in range(w - 2, -1, -1):
            step = _log_sum(pairs + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(known[:, t + 1, None], step, 0.0)
        total = _log_sum(ahead[:, -1], 1)
        mass = np.exp(ahead + back - total[:, None, None]) * known[..., None]
        joint = np.exp(
            ahead[:, :-1, :, None] + pairs + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
        diff = hot - mass
        grad = np.zeros_like(weights)
        for j in range(k):
            for y in range(3):
                grad[:, y] += np.bincount(flat[..., j].ravel(), weights=diff[..., y].ravel(), minlength=len(weights))
        grad -= PENALTY * n * weights
        grad_pairs = seen_pairs - (joint * both[..., None, None]).sum(axis=(0, 1)) - PENALTY * n * np.where(pairs > _NEVER, pairs, 0)
        grad_pairs[O, I] = 0
        grown += grad * grad
        grown_pairs += grad_pairs * grad_pairs
        weights += RATE * grad / np.sqrt(grown)
        pairs += RATE * grad_pairs / np.sqrt(grown_pairs)
        pairs[O, I] = _NEVER
    return Field(tuple(weights[a:b].astype(np.float32) for a, b in zip(sizes[:-1], sizes[1:], strict=True)), pairs)


def viterbi(scores: np.ndarray, pairs: np.ndarray) -> list[int]:
    """The best tags of a run of words with outside before and behind it."""
    best = scores[0] + pairs[O]
    best[I] = _NEVER
    back = []
    for row in scores[1:]:
        ways = best[:, None] + pairs
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tag = int((best + pairs[:, O]).argmax())
    tags = [tag]
    for step in reversed(back):
        tag = int(step[tag])
        tags.append(tag)
    return tags[::-1]


def tagged_runs(field: Field, features: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """The runs of words (first, last + 1) that the best tagging of each text says are secrets."""
    if len(features) == 0:
        return []
    scores = field.scores(features).astype(np.float64)
    pairs = field.pairs
    # what a pair of tags that are not both outside can gain over one that is
    extra = max(0.0, float(np.delete((pairs - pairs[O, O]).ravel(), 0).max()))
    gain = scores[:, [B, I]].max(axis=1) - scores[:, O] + extra
    total = np.concatenate([[0.0], np.cumsum(gain)])
    least = np.minimum.accumulate(total[:-1])
    most = np.maximum.accumulate(total[:0:-1])[::-1]
    open_ = most - least + extra > 0
    at = np.flatnonzero(open_)
    if len(at) == 0:
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])) + 1
    out = []
    for part in np.split(at, cut):
        start = None
        for word, tag in zip([*part, part[-1] + 1], [*viterbi(scores[part], pairs), O], strict=True):
            if start is not None and tag != I:
                out.append((int(start), int(word)))
                start = None
            if tag == B:
                start = word
    return out


def _spans_of(block: Block, row: int) -> tuple[str, list[tuple[int, int, str]]]:
    text = block.data[block.text_at[row]: block.text_at[row + 1]].tobytes().decode()
    return text, base_spans(text)


def _byte_place(text: str, at: int) -> int:
    return len(text[:at].encode())


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats, tags = [], []
        for block in blocks(batch.column("text")):
            features, may = word_features(block), _may_match(block)
            for row in range(block.rows):
                first, end = int(block.word_at[row]), int(block.word_at[row + 1])
                if first == end:
                    continue
                tag = np.zeros(end - first, dtype=np.int8)
                centres = []
                if may[row]:
                    text, found = _spans_of(block, row)
                    base = int(block.text_at[row])
                    for s, e, _ in found:
                        s, e = base + _byte_place(text, s), base + _byte_place(text, e)
                        a = int(np.searchsorted(block.ends[first:end], s, side="right"))
                        b = int(np.searchsorted(block.starts[first:end], e))
                        if not tag[a:b].any():
                            tag[a:b], tag[a] = I, B
                            centres.append(a)
                centres = [*centres[: WINDOWS_PER_DOC - 1], (end - first) // 2]
                for centre in centres:
                    a = max(0, centre - WINDOW // 2)
                    # a window does not begin inside a secret
                    while a > 0 and tag[a] == I:
                        a -= 1
                    feats.append(features[first + a: min(first + a + WINDOW, end)].ravel())
                    tags.append(tag[a: a + WINDOW])
        if feats:
            yield pa.RecordBatch.from_arrays(
                [pa.array(feats, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int8()))], names=["features", "tags"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.zeros(batch.num_rows, dtype=np.int8)
        for block in blocks(batch.column("text")):
            for row in np.flatnonzero(_may_match(block)).tolist():
                marks[block.first + row] = bool(_spans_of(block, row)[1])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks)], names=["id", "mark"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """A field from at most ``sample_docs`` texts with a match of a pattern and as many without, chosen by hash of the id;
    None if no pattern matches in any text.

    All texts are marked in one pass. The driver gets at most ``WINDOWS_PER_DOC`` windows of ``WINDOW`` words of each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    marked = stored(arrow_map(rows, _marked, f"id {rows.schema['id'].dataType.simpleString()}, mark byte"), "secret-marks")
    picked = picked_rows(marked, "id", "mark", sample_docs).select("id").distinct()
    sample = fetched(rows, picked, "id").select("text")
    got = arrow_map(sample, _training_rows, "features array<int>, tags array<byte>").orderBy(
        F.xxhash64("features"), "features", "tags").collect()
    if not any(tag for r in got for tag in r.tags):
        return None
    n, k = len(got), len(TABLES)
    features, tags = np.zeros((n, WINDOW, k), dtype=np.int64), np.zeros((n, WINDOW), dtype=np.int64)
    known = np.zeros((n, WINDOW), dtype=bool)
    for i, r in enumerate(got):
        m = len(r.tags)
        features[i, :m] = np.array(r.features).reshape(m, k)
        tags[i, :m], known[i, :m] = r.tags, True
    return learn(features, tags, known)


def scan(docs: DataFrame, field: Field | None, text_col: str = "text", to_col: str = "found") -> DataFrame:
    """``docs`` with ``to_col`` added (or replaced): an array of (start, end, kind) of all secrets, by start, then kind.

    Matches of the fixed patterns are always there. What the field tags beside them has the kind ``field``; tagged runs
    that touch a match are left to it. Offsets are code points, ends exclusive. A null or empty text has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rest = docs.drop(to_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            lists: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for block in blocks(batch.column(batch.schema.names.index(text_col))):
                runs: dict[int, list[tuple[int, int]]] = {}
                if chain is not None:
                    row_of = block.row_of_word()
                    for a, b in tagged_runs(chain, word_features(block), row_of):
                        runs.setdefault(int(row_of[a]), []).append((int(block.starts[a]), int(block.ends[b - 1])))
                for row in sorted({*np.flatnonzero(_may_match(block)).tolist(), *runs}):
                    text, spans = _spans_of(block, row)
                    if row in runs:
                        raw, base, more = text.encode(), int(block.text_at[row]), []
                        for s, e in runs[row]:
                            s, e = len(raw[: s - base].decode()), len(raw[: e - base].decode())
                            if all(e <= x or y <= s for x, y, _ in spans):
                                more.append((s, e, KINDS[3]))
                        spans = sorted([*spans, *more], key=lambda x: (x[0], KINDS.index(x[2])))
                    lists[block.first + row] = [{"start": s, "end": e, "kind": k} for s, e, k in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, kind)], names=[*batch.schema.names, to_col])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]
    return arrow_map(rest, run, ", ".join([*fields, f"`{to_col}` array<struct<start:bigint,end:bigint,kind:string>>"]))


def redacted(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``[secret]``; overlapping ones by one. Null stays null."""
    columns, spans_col = docs.columns, "_secret_spans"
    found = scan(docs, field, text_col, spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(batch.schema.names.index(spans_col))):
                if not len(spans.values):
                    continue
                text, out, done = texts[i], [], 0
                for span in spans.as_py():
                    if span["start"] >= done:
                        out += [text[done: span["start"]], "[secret]"]
                    done = max(done, span["end"])
                texts[i] = "".join([*out, text[done:]])
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[columns.index(text_col)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return arrow_map(found, run, ", ".join(fields))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, matches of each pattern, the digest of the matches and all spans, as kind:start:end joined by commas."""
    text = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    base = "filter(found, x -> x.kind <> 'field')"
    return found.select(
        id_col,
        *(F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.expr(text.format(base)), 256).alias("base_sha256"), F.expr(text.format("found")).alias("spans"))
