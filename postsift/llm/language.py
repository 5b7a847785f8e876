"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of sample text. A text is put in lower case and
cut into pieces of ``PIECE_BYTES``, every piece is compressed with every dictionary, and the language with the fewest
bytes in all wins. Pieces keep the dictionary in play however long the text is.

The sizes are read as code lengths: the score of the winner is its share of 2 ** (-bytes) over all languages. A text
is rejected when the runner-up needs less than ``min_margin`` of the winner's bytes more, or when it has no letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import arrow_map
from postsift.llm.sampling import fetched, picked_rows

UNKNOWN = "und"
PIECE_BYTES = 2048
#: A shorter text is repeated to this length: else it is stored as it is, whatever the dictionary.
SHORT_BYTES = 256
#: The bounded sample: documents per language, bytes of each, bytes of a dictionary, languages.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 400
DICTIONARY_BYTES = 96 << 10
MAX_LANGUAGES = 500
#: Chosen on held-out rows: clean texts stay, most of those that are half in one language and half in another go.
MIN_MARGIN = 0.04

_LETTER = regex.compile(r"\p{L}")


def fit(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_language: int = SAMPLE_DOCS, bytes_per_doc: int = SAMPLE_BYTES,
) -> dict[str, bytes]:
    """One dictionary per language, from a bounded sample of labelled rows.

    Rows with a null id, text or language are not used. At most ``docs_per_language`` documents of a language and
    ``bytes_per_doc`` characters of each reach the driver; more than ``MAX_LANGUAGES`` languages are an error.
    """
    usable = rows.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "id is not null and lang is not null and text is not null")
    if len(usable.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()) > MAX_LANGUAGES:
        raise ValueError("more languages than a classifier of dictionaries is meant for")
    chosen = picked_rows(usable, "id", "lang", docs_per_language)
    sample = fetched(usable.drop("lang"), chosen, "id").select(
        "id", "lang", F.substring("text", 1, bytes_per_doc).alias("text")).collect()
    out: dict[str, bytes] = {}
    for row in sorted(sample, key=lambda r: (r.lang, str(r.id), r.text)):
        out[row.lang] = out.get(row.lang, b"") + row.text.lower().encode() + b"\n"
    return {lang: body[:DICTIONARY_BYTES] for lang, body in out.items()}


class Classifier:
    def __init__(self, dictionaries: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in dictionaries]
        self.compress = []
        for _, body in dictionaries:
            # short matches, since words of one language share short pieces
            settings = zstandard.ZstdCompressionParameters(
                window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=3, target_length=16,
                strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            data = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=settings)
            self.compress.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=data).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """The language, its score and whether it is rejected."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = text.lower().encode()
        if len(raw) < SHORT_BYTES:
            raw = (raw + b"\n") * -(-SHORT_BYTES // (len(raw) + 1))
        pieces = [raw[i: i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        sizes = np.array([sum(len(pack(p)) for p in pieces) for pack in self.compress], dtype=np.float64)
        best = int(np.argmin(sizes))
        over = sizes - sizes[best]
        score = float(1.0 / np.exp2(-np.minimum(over, 1000)).sum())
        margin = float(np.delete(over, best).min()) if len(over) > 1 else np.inf
        return self.langs[best], score, margin < self.min_margin * sizes[best]

    min_margin: float = MIN_MARGIN


@lru_cache(maxsize=2)
def _classifier(dictionaries: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dictionaries)


def predict(docs: DataFrame, model: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected`` added (replaced where they are there).

    A text that is null or has no letter gets ``und``, score 0, and is rejected; so does every text when no language was
    learned, and one with a narrow margin, which most texts in two languages have. Of languages that tie, the first by name
    is given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(model.items())))
    rest = docs.drop("lang_pred", "score", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            langs, scores, rejected = zip(*map(classify, texts), strict=True) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema]
    return arrow_map(rest, run, ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))


def accepted(docs: DataFrame, model: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected (see ``predict``)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(model.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.filter(pa.array([not classify(t)[2] for t in texts], pa.bool_()))

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
