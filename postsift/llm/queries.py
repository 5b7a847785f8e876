"""The registered queries of this folder, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.llm import (
    bpe_codec, decontamination, exact_search, filter_audit, hard_negatives, language, ngram_join, quality_votes,
    secret_spans, substring_dedup, token_counts, token_files, toxicity,
)
from postsift.llm.common import documents, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file is; the workers have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@_query("op1_substring_dedup", f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (
        SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
    ),
    l AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS m FROM s) WHERE m < doc_id),
    g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM l),
    o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM o ANTI JOIN g USING (doc_id, p) GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), with_text=False)


@_query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


@_query("op8_bpe_codec")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), keep=True)


@_query("op7_ngram_join", r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
        UNION ALL
        SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
        GROUP BY 1, 2
    ),
    l AS (
        SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
        WHERE 100 * o >= 80 * (nx.n + ny.n - o)
    ),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(documents(spark, sf_dir))


@_query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    manifest = token_files.write(documents(spark, sf_dir), folder, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read(manifest, folder)


def _part(doc_id: str, parts: int):
    """Which part of the documents an id is in: the contracts' folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


@_query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", _part("doc_id", 4) == 2)
    model = language.fit(docs.where(~F.col("held_out")))
    return language.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", _part("doc_id", 3) == 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_part("doc_id", 3) != 1)
    weights = toxicity.fit(docs, labels)
    return toxicity.score(docs, weights).select("doc_id", "held_out", "score", "predicted")


@_query("op5_secret_spans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = secret_spans.fit(docs)
    return secret_spans.digest(secret_spans.scan(docs, field).drop("text"))


@_query("op6_quality_votes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@_query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminated(documents(spark, sf_dir), benchmark)


@_query("op11_filter_audit", f"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
    marks AS (
        SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
        FROM labels GROUP BY doc_id
    ),
    f AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END)
            || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
            || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
            || (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
        FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id
    ),
    g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ),
    s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
    t AS (SELECT *, filter_order[step] AS letter FROM s),
    m AS (SELECT DISTINCT fails FROM g),
    r AS (SELECT fails, filter_order, coalesce(min(step) FILTER (contains(fails, letter)), 6) AS gone FROM m, t GROUP BY ALL),
    a AS (
        SELECT part, t.filter_order, step, letter,
            coalesce(sum(n) FILTER (gone > step), 0) AS kept,
            coalesce(sum(n) FILTER (gone = step), 0) AS removed,
            coalesce(sum(n) FILTER (gone < step AND contains(g.fails, letter)), 0) AS redundant,
            coalesce(sum(n) FILTER (g.fails = letter), 0) AS unique_fails,
            coalesce(sum(n) FILTER (gone = step AND good), 0) AS good_lost,
            coalesce(sum(n) FILTER (gone = step AND toxic), 0) AS toxic_lost
        FROM g JOIN r ON r.fails = g.fails JOIN t ON t.filter_order = r.filter_order GROUP BY ALL
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM a
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_texts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_SCALED = """
    SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""


@_query("op12_hard_negatives", f"""
    WITH e AS ({_SCALED.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")} AND label IS NOT NULL),
    p AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
            CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ),
    g AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT g.anchor_id, positive_id,
        CAST(row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT same
        AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label)
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))


@_query("op13_exact_top_k", f"""
    WITH e AS ({_SCALED.format(label="0")})
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score,
        CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) AS INTEGER) AS rank
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    QUALIFY rank <= 5
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_search.search(rows, rows.where("vec_id % 50 = 0"))
