"""From documents to digests of token ids: five stages, each one of the training-text operators.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. All but the last return the columns of
``documents``. Between two stages the rows are written as Parquet to the shared folder and read again, which cuts
the lineage: a lost executor costs the running stage's tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.llm import bpe_codec, decontamination, language, ngram_join, secret_spans
from postsift.llm.common import documents, stored
from postsift.llm.queries import tokenizer_file


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told; without a letter, or between two languages, they go."""
    return language.accepted(docs, language.fit(docs))


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the smallest id."""
    return ngram_join.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark passage."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, with their secrets replaced; ``n_chars`` follows the text."""
    return secret_spans.redacted(docs, secret_spans.fit(docs)).withColumn(
        "n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens, and digests of the ids and of the decoded texts."""
    return bpe_codec.round_trip(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("ngram_join", one_of_a_kind),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

#: Trained models and a tokenizer take part, which SQL does not have; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
