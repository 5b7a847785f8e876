"""The test tables seen as postings, history, outcomes, run logs and notes.

Nothing else knows the test tables by name. Each adapter is one SQL text that
Spark and DuckDB both understand, or two texts where the dialects part.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.session import ensure_checkpoint_dir, spread

#: The day the reports are drawn up for.
TODAY = dt.date(2024, 1, 30)


#: Tables of long texts: the work per row is heavy, so they are read in as many
#: parts as there are cores even where one small file holds them all.
_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, _TEXT_KEYS[name]) if name in _TEXT_KEYS else rows


# Regular expressions are written RX'...' in shared SQL: Spark reads them as raw
# literals, DuckDB as plain ones. SHA(...) is each engine's SHA-256.


def duck_text(sql: str) -> str:
    return sql.replace("RX'", "'").replace("SHA(", "sha256(")


def derive(spark: SparkSession, sf_dir: str, ctes: str, final: str) -> DataFrame:
    """``WITH <ctes> SELECT * FROM <final>`` over the test tables the text names."""
    body = ctes.replace("RX'", "r'")
    while "SHA(" in body:
        start = body.index("SHA(")
        depth, end = 0, start + 3
        while True:
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            if depth == 0:
                break
            end += 1
        body = f"{body[:start]}sha2({body[start + 4:end]}, 256){body[end + 1:]}"
    names = [n for n in SOURCE_TABLES if re.search(rf"(?:FROM|JOIN) {n}\b", body)]
    heads = [f"{n} AS (SELECT * FROM {{{n}}})" for n in names]
    body = body.replace("{", "{{").replace("}", "}}")
    return spark.sql(
        f"WITH {', '.join([*heads, body])} SELECT * FROM {final}",
        **{n: table(spark, sf_dir, n) for n in names},
    )


SOURCE_TABLES = ("documents", "labels", "events", "pages", "benchmark", "conversations")

_TITLE = r"regexp_extract(text, RX'^(\S+(?:\s+\S+){0,5})', 1)"
_COMPANY = """CASE lang WHEN 'en' THEN CASE WHEN doc_id % 2 = 0 THEN 'Northwind Denmark A/S' ELSE 'Northwind' END
            WHEN 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN 'Østerby ApS' ELSE 'Osterby' END
            WHEN 'de' THEN 'Contoso GmbH' ELSE 'Fabrikam' END"""
_URL = "concat('https://', source, '.example/', CAST(doc_id AS STRING))"

_POSTINGS = f"""postings AS (SELECT doc_id AS pos, {_TITLE} AS title, {_COMPANY} AS company,
  CASE lang WHEN 'en' THEN 'Berlin, Germany' WHEN 'fr' THEN '' WHEN 'de' THEN 'Aarhusgade 12'
            ELSE 'Aarhus, Denmark' END AS location,
  text AS description, {_URL} AS url,
  CASE doc_id % 5 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'careerjet'
                  WHEN 3 THEN 'jobindex' ELSE 'other' END AS site,
  CAST(CAST(DATE'2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS STRING) AS date_posted,
  CASE WHEN doc_id % 3 = 0 THEN concat('EUR ', CAST(40000 + doc_id AS STRING)) ELSE '' END AS salary,
  CASE WHEN doc_id % 4 = 0 THEN 'fulltime' ELSE '' END AS job_type,
  doc_id % 7 = 0 AS is_remote,
  CASE doc_id % 3 WHEN 0 THEN 'platform engineer' WHEN 1 THEN 'data architect'
                  ELSE 'analyst' END AS search_term
  FROM documents)"""

_SEEN = f"""seen AS (SELECT doc_id, substr(SHA({_URL}), 1, 16) AS job_id, {_URL} AS url,
  {_TITLE} AS title, {_COMPANY} AS company,
  CASE lang WHEN 'en' THEN 'Berlin, Germany' ELSE '' END AS location,
  source AS site,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST((doc_id*37) % 101 AS DOUBLE) END AS score,
  CASE doc_id % 10 WHEN 0 THEN 'rejected_location' WHEN 1 THEN 'rejected_prefilter'
    WHEN 2 THEN 'scoring_error' WHEN 3 THEN 'rejected_language' ELSE 'new' END AS status,
  CAST(DATE'2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS first_seen,
  '' AS date_posted, '' AS search_term,
  CASE WHEN doc_id % 10 > 3 AND doc_id % 6 = 0 THEN '{{"score": broken'
       WHEN doc_id % 10 > 3 THEN concat('{{"score": ', CAST((doc_id*37) % 101 AS STRING),
         ', "key_matches": ["sql", "spark"], "gaps": ["rust"], "reasoning": "row ',
         CAST(doc_id AS STRING), '"}}') ELSE '' END AS verdict_json,
  CAST(1 + doc_id % 5 AS INT) AS attempts FROM documents)"""

# --- outcomes: what became of the labelled postings --------------------------------------

_OUTCOMES = r"""outcomes AS (SELECT d.pos AS doc_id,
  CASE WHEN d.pos % 2 = 1 THEN regexp_replace(d.title, RX'\s+\S+$', '') ELSE d.title END AS title,
  CASE WHEN d.pos % 9 = 0 THEN '' ELSE d.company END AS company,
  CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'offer'
       WHEN l.quality = 0 AND l.toxic = 0 THEN 'Rejected after final round'
       WHEN l.quality = 0 THEN 'no response'
       WHEN d.pos % 11 = 0 THEN 'withdrawn'
       WHEN d.pos % 11 = 1 THEN 'first screen booked'
       WHEN d.pos % 11 = 2 THEN 'video call on Monday'
       WHEN d.pos % 11 = 3 THEN 'drafting'
       ELSE 'applied' END AS status
  FROM postings d JOIN labels l ON l.doc_id = d.pos)"""

POSTINGS = duck_text(_POSTINGS)
SEEN = duck_text(_SEEN)
OUTCOMES = duck_text(_POSTINGS + ", " + _OUTCOMES)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _POSTINGS, "postings")


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _SEEN, "seen")


def seen_with_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History with the stored description head, as the fuzzy checks read it."""
    heads = table(spark, sf_dir, "documents").select(
        "doc_id", tx.description_head(F.col("text")).alias("desc_head")
    )
    return seen(spark, sf_dir).join(heads, "doc_id")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, _POSTINGS + ", " + _OUTCOMES, "outcomes")


# --- source runs -----------------------------------------------------------------------

#: One run per day and event type; type 'error' is blank for the last three days,
#: and no event on a day counts as a run with nothing.
_RUN_LOG = """days AS (SELECT DISTINCT CAST(ts AS DATE) AS run_day FROM events),
  grid AS (SELECT run_day, @KINDS@ AS source FROM days),
  counted AS (SELECT CAST(ts AS DATE) AS run_day, event_type AS source, count(*) AS n FROM events
    WHERE NOT (event_type = 'error' AND CAST(ts AS DATE) >= DATE'2024-01-28') GROUP BY 1, 2),
  run_log AS (SELECT g.run_day AS run_id, g.source,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n,
      CASE WHEN g.source = 'view' AND day(g.run_day) % 5 = 0 THEN 'HTTP 429 Too Many Requests'
           WHEN g.source = 'click' AND day(g.run_day) % 7 = 0 THEN 'parse failed' END AS error
    FROM grid g LEFT JOIN counted c ON c.run_day = g.run_day AND c.source = g.source)"""
RUN_LOG = _RUN_LOG.replace("@KINDS@", "unnest((SELECT list(DISTINCT event_type) FROM events))")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, source, n, error): a full grid of a few sources and days."""
    return derive(
        spark, sf_dir, _RUN_LOG.replace("@KINDS@", "explode((SELECT collect_set(event_type) FROM events))"), "run_log"
    )


# --- replies ------------------------------------------------------------------------------

REPLIES = """replies AS (SELECT event_id AS update_id, CAST(user_id AS STRING) AS chat_id, ts,
  CASE event_type WHEN 'signup' THEN '/done' WHEN 'error' THEN '/help'
       WHEN 'click' THEN '  ' ELSE concat(event_type, ' ', CAST(event_id AS STRING)) END AS text
  FROM events)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REPLIES, "replies")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
