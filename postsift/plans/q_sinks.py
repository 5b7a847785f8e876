"""Registered queries: what the sinks write (K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.operators import digest, reports, scoring
from postsift.plans.adapters import POSTINGS, SEEN, TODAY, derive, postings, seen, shared_path, table
from postsift.plans.q_applications import _RECORDS, records
from postsift.plans.q_dedup import archive, scored_batch
from postsift.plans.q_rules import _HAS, _REPLIES, _STATUS
from postsift.plans.q_text import _PLANTED, _redact, planted
from postsift.plans.registry import ORACLES, query
from postsift.sources import sinks
from postsift.sources.feeds import complete_seen

_RUN_AT = "2024-01-30T08:00:00"


def scored(spark, d):
    """Every posting with the verdict its scorer gave."""
    replies = derive(spark, d, _REPLIES, "replies").withColumnRenamed("doc_id", "pos")
    parsed = replies.withColumn("verdict", scoring.parse_verdict(F.col("reply"))).select("pos", "verdict")
    return scoring.derive_status(postings(spark, d).join(parsed, "pos"), reject_too_senior=True)


_POINTS = "CAST(least(100, (pos * 37) % 131) AS INTEGER)"
_SCORED = f"""{POSTINGS}, scored AS (SELECT p.*, {_STATUS.replace('doc_id', 'pos')} AS status,
  CASE WHEN {_STATUS.replace('doc_id', 'pos')} = 'new' THEN {_POINTS} ELSE 0 END AS score, {_HAS.replace('doc_id', 'pos')} AS has,
  CASE WHEN {_HAS.replace('doc_id', 'pos')} AND pos % 7 <> 0 THEN concat('fits {{well}}, ', lang) ELSE '' END AS reasoning
  FROM postings p JOIN (SELECT doc_id, lang FROM documents) d ON d.doc_id = p.pos)"""


@query("k1_write_csv", f"""WITH {_SCORED} SELECT '{_RUN_AT}' AS run_at, score, title, company, location, site, salary, url,
  CASE WHEN has THEN 'a, b; c' ELSE '' END AS key_matches, '' AS gaps, reasoning, search_term FROM scored""")
def _k1(spark, d):
    path = shared_path(spark, "csv")
    sinks.write_csv(scored(spark, d), path, _RUN_AT)
    back = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return back.fillna("").withColumn("score", F.col("score").cast("int"))


@query("k2_write_jsonl", f"""WITH {_SCORED} SELECT concat('{{"pos":', pos, ',"site":"', site, '","score":', score, ',"run_at":"{_RUN_AT}"}}') AS value FROM scored""")
def _k2(spark, d):
    path = shared_path(spark, "jsonl")
    sinks.write_jsonl(scored(spark, d), path, _RUN_AT)
    back = spark.read.schema("pos long, site string, score int, run_at string").json(path)
    return back.select(F.to_json(F.struct("pos", "site", "score", "run_at")).alias("value"))


_MARKDOWN = f"""WITH {_SCORED} SELECT pos, score, concat_ws(chr(10), concat('### ', score, '% ', title), concat('**', company, '**. ', location, ' (', site, ')'),
  CASE WHEN salary <> '' THEN concat('Salary: ', salary) END, CASE WHEN has THEN 'Matches: a, b, c' END, CASE WHEN reasoning <> '' THEN concat('Why: ', reasoning) END, concat('<', url, '>'), '') AS entry FROM scored"""


@query("k3_write_digest", f"SELECT pos, entry FROM ({_MARKDOWN})")
def _k3(spark, d):
    return scored(spark, d).select("pos", digest.markdown_entry().alias("entry"))


@query("k3_write_digest_text", f"""WITH {_SCORED} SELECT pos, concat_ws(chr(10), concat('[', CASE WHEN score >= 80 THEN 'STRONG' WHEN score >= 65 THEN 'POSSIBLE' ELSE 'LONG SHOT' END, '] ', score, '% ', title),
  concat('Company:  ', company), concat('Location: ', CASE WHEN location <> '' THEN concat(location, ' ') ELSE '' END, '[', upper(site), ']'),
  CASE WHEN salary <> '' THEN concat('Salary:   ', salary) END, CASE WHEN has THEN 'Matches:  a, b | c' END, CASE WHEN reasoning <> '' THEN concat('Why:      ', reasoning) END, concat('Link:     ', url)) AS entry FROM scored""")
def _k3b(spark, d):
    return scored(spark, d).select("pos", digest.job_lines().alias("entry"))


@query("k3_write_digest_file", f"""WITH entries AS ({_MARKDOWN} ORDER BY score DESC, pos),
  lines AS (SELECT string_split(string_agg(entry, chr(10) ORDER BY score DESC, pos), chr(10)) AS l FROM entries)
SELECT unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM lines""")
def _k3_file(spark, d):
    """Written in order of scores, read back in the order of the files."""
    path = shared_path(spark, "digest")
    sinks.write_digest(scored(spark, d), path)
    return sinks.read_digest(spark, path)


_STATS = """st AS (SELECT site, CASE WHEN site = 'other' THEN 0 ELSE count(*) END AS fetched, CASE WHEN site IN ('other', 'indeed') THEN 0 ELSE count(*) FILTER (status <> 'rejected_language') END AS new,
  CASE WHEN site IN ('other', 'indeed') THEN 0 ELSE count(*) FILTER (status <> 'rejected_language' AND NOT (status = 'new' AND score >= 65)) END AS rejected,
  CASE WHEN site IN ('other', 'indeed') THEN 0 WHEN site = 'linkedin' THEN 1 ELSE count(*) FILTER (status = 'new' AND score >= 65) END AS matched FROM scored GROUP BY site)"""


def _site_stats(spark, d):
    none = F.col("site").isin("other", "indeed")
    hit = (F.col("status") == "new") & (F.col("score") >= 65)
    kept = F.col("status") != "rejected_language"
    counts = scored(spark, d).groupBy("site").agg(
        F.count("*").alias("f"), F.count_if(kept).alias("n"), F.count_if(kept & ~hit).alias("r"), F.count_if(hit).alias("m")
    )
    return counts.select(
        "site", F.when(F.col("site") == "other", 0).otherwise(F.col("f")).alias("fetched"),
        F.when(none, 0).otherwise(F.col("n")).alias("new"), F.when(none, 0).otherwise(F.col("r")).alias("rejected"),
        F.when(none, 0).when(F.col("site") == "linkedin", 1).otherwise(F.col("m")).alias("matched"),
    )


@query("k4_digest_header", f"""WITH {_SCORED}, {_STATS} SELECT site, concat('Postings, 30 Jan 2024', chr(10), matched, CASE WHEN matched = 1 THEN ' match' ELSE ' matches' END, ' | ', new, ' new | ',
  rejected, ' below 65 | ', fetched, ' fetched') AS header FROM st""")
def _k4(spark, d):
    return digest.digest_header(_site_stats(spark, d), TODAY, 65).select("site", "header")


@query("k4_no_match_body", f"""WITH {_SCORED}, {_STATS} SELECT site, CASE WHEN site = 'jobindex' THEN 'quiet' WHEN fetched = 0 THEN concat('Every source returned 0 jobs.', chr(10),
  'That normally means a source is blocked or misconfigured rather than that the market is quiet.', chr(10), 'Sources: none ran')
  WHEN new = 0 THEN concat('No new postings today.', chr(10), 'Fetched ', fetched, ', all of them already seen.', chr(10), 'Sources: ', site)
  ELSE concat('No matches at or above 65.', chr(10), 'Scanned ', new, ' new | ', rejected, ' below threshold | ', fetched, ' fetched.', chr(10), 'Sources: ', site) END AS body FROM st""")
def _k4b(spark, d):
    sources = F.when(F.col("site") != "other", F.col("site"))
    empty = F.when(F.col("site") == "jobindex", "quiet")
    return _site_stats(spark, d).select("site", digest.no_match_body(65, sources, empty).alias("body"))


@query("k5_roundup_header", f"""WITH {SEEN}, h AS (SELECT count(*) AS n FROM seen WHERE status = 'new' AND score >= 65 AND first_seen BETWEEN DATE'2024-01-24' AND DATE'2024-01-30')
SELECT 'Postings roundup, 24 Jan to 30 Jan 2024' AS title, concat(CASE WHEN n > 10 THEN concat('best 10 of ', n, ' matches') WHEN n = 1 THEN '1 match' ELSE concat(n, ' matches') END, ' at or above 65') AS subtitle FROM h""")
def _k5(spark, d):
    return digest.roundup_header(reports.roundup(seen(spark, d), TODAY), TODAY, 7, 65)


@query("k6_chunk_message", """WITH RECURSIVE parts AS (SELECT doc_id, string_split(text, chr(10)) AS p, length(text) AS total, text FROM documents),
  l AS (SELECT doc_id, total, text, list_transform(list_filter(range(1, len(p) + 1), lambda i: i < len(p) OR p[i] <> ''), lambda i: CASE WHEN i < len(p) THEN concat(p[i], chr(10)) ELSE p[i] END) AS ls FROM parts),
  w AS (SELECT doc_id, ls, 1 AS i, ls[1] AS open, CAST(0 AS INTEGER) AS chunk, CAST(NULL AS VARCHAR) AS closed FROM l WHERE total > 700
    UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN length(open) + length(ls[i + 1]) > 700 THEN ls[i + 1] ELSE concat(open, ls[i + 1]) END,
      CAST(CASE WHEN length(open) + length(ls[i + 1]) > 700 THEN chunk + 1 ELSE chunk END AS INTEGER), CASE WHEN length(open) + length(ls[i + 1]) > 700 THEN open END
    FROM w WHERE i < len(ls))
SELECT doc_id, CAST(0 AS INTEGER) AS chunk, text AS body FROM l WHERE total <= 700
UNION ALL SELECT doc_id, chunk - 1, closed FROM w WHERE closed IS NOT NULL UNION ALL SELECT doc_id, chunk, open FROM w WHERE i = len(ls)""")
def _k6(spark, d):
    return digest.chunk_message(table(spark, d, "documents"), "doc_id", "text", 700)


@query("k7_alert_note", f"""WITH {_PLANTED} SELECT doc_id, concat('Postings ALERT, 30 Jan 2024', chr(10), chr(10), {_redact('body')}) AS alert,
  concat('Postings, 30 Jan 2024', chr(10), chr(10), {_redact('body')}) AS note FROM planted""")
def _k7(spark, d):
    return planted(spark, d).select(
        "doc_id", digest.alert_text(F.col("body"), TODAY).alias("alert"), digest.note_text(F.col("body"), TODAY).alias("note")
    )


@query("k8_write_seen", ORACLES["d9_upsert_seen"])
def _k8(spark, d):
    """Two versions of a stored history: the old one, then the one with this batch."""
    root = shared_path(spark, "history")
    sinks.store_days(complete_seen(archive(spark, d)), root, "v1")
    sinks.write_seen(scored_batch(spark, d), root, TODAY, "v2")
    return sinks.read_history(spark, root).select("job_id", "title", "status", "attempts", "first_seen")


@query("k9_write_outcomes", f"WITH {_RECORDS} SELECT CASE WHEN role = '' THEN folder ELSE role END AS title, company, status, folder FROM records WHERE status <> ''")
def _k9(spark, d):
    title = F.coalesce(F.nullif("role", F.lit("")), F.col("folder"))
    path = shared_path(spark, "outcomes")
    sinks.write_outcomes(records(spark, d).filter("status != ''").withColumn("title", title), path)
    return spark.read.csv(path, header=True, escape='"', multiLine=True).fillna("").select(*fixed.OUTCOME_COLUMNS)
