"""Registered queries: reports, source health, calibration (A1-A12, H*, C*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.operators import calibration as cal
from postsift.operators import health, hygiene, reports
from postsift.plans.adapters import (
    OUTCOMES, POSTINGS, RUN_LOG, SEEN, TODAY, derive, outcomes, postings, run_log, seen, table,
)
from postsift.plans.q_hygiene import GUARD_ROWS, hostile
from postsift.plans.q_ingest import _STATUS
from postsift.plans.registry import query

_SC = "status = 'new' AND score IS NOT NULL"
_BAND = """CASE WHEN score >= 80 THEN '80 to 100' WHEN score >= 70 THEN '70 to 79' WHEN score >= 60 THEN '60 to 69'
  WHEN score >= 50 THEN '50 to 59' WHEN score >= 40 THEN '40 to 49' ELSE 'under 40' END"""


@query("a1_totals", f"""WITH {SEEN} SELECT count(*) AS total, count(*) FILTER ({_SC}) AS scored,
  count(*) FILTER (status = 'new' AND score >= 65) AS cleared FROM seen""")
def _a1(spark, d):
    return reports.totals(seen(spark, d))


@query("a2_status_counts", f"WITH {SEEN} SELECT status, count(*) AS n FROM seen GROUP BY status")
def _a2(spark, d):
    return reports.status_counts(seen(spark, d))


@query("a3_score_histogram", f"WITH {SEEN} SELECT {_BAND} AS band, count(*) AS n FROM seen WHERE {_SC} GROUP BY 1")
def _a3(spark, d):
    return reports.score_histogram(seen(spark, d))


@query("a4_daily_scored", f"""WITH {SEEN} SELECT first_seen, count(*) AS n, max(score) AS best, max(score) < 99 AS nothing_cleared
FROM seen WHERE {_SC} AND first_seen >= DATE'2024-01-16' GROUP BY 1""")
def _a4(spark, d):
    return reports.daily_scored(seen(spark, d), TODAY, 14, 99)


@query("a5_top_scores", f"""WITH {SEEN} SELECT job_id, score, title, company, first_seen FROM seen WHERE {_SC}
ORDER BY score DESC, job_id LIMIT 8""")
def _a5(spark, d):
    return reports.top_scores(seen(spark, d))


@query("a6_bar", f"""WITH {SEEN}, c AS (SELECT status, count(*) AS n FROM seen GROUP BY 1)
SELECT status, n, repeat('#', CAST(greatest(1, round_even(34 * n / (SELECT max(n) FROM c), 0)) AS INTEGER)) AS bar FROM c""")
def _a6(spark, d):
    return reports.with_bars(reports.status_counts(seen(spark, d)))


@query("a7_window_range", f"""WITH {SEEN} SELECT job_id, CAST(first_seen - (greatest(1, attempts - 2) - 1) AS DATE) AS first, first_seen AS last FROM seen""")
def _a7(spark, d):
    days = seen(spark, d).select("job_id", F.col("first_seen").alias("today"), (F.col("attempts") - 2).alias("days"))
    return reports.window_bounds(days).select("job_id", "first", "last")


@query("a8_roundup", f"""WITH {SEEN}, hits AS (SELECT * FROM seen WHERE status = 'new' AND score >= 65
  AND first_seen BETWEEN DATE'2024-01-24' AND DATE'2024-01-30')
SELECT job_id, title, company, CAST(round_even(score, 0) AS INTEGER) AS score, (SELECT count(*) FROM hits) AS total,
  CASE WHEN doc_id % 6 <> 0 THEN concat('row ', doc_id) END AS reasoning
FROM hits ORDER BY hits.score DESC, company, job_id LIMIT 10""")
def _a8(spark, d):
    best = reports.roundup(seen(spark, d), TODAY, 7, 65, 10)
    return best.select("job_id", "title", "company", "score", "total", F.col("verdict.reasoning").alias("reasoning"))


@query("a9_run_stats", f"""WITH {SEEN} SELECT count(*) AS fetched, count(*) FILTER (status <> 'rejected_location') AS new,
  count(*) FILTER (status <> 'rejected_location' AND NOT coalesce(status = 'new' AND score >= 65, false)) AS rejected,
  count(*) FILTER (status <> 'rejected_location' AND coalesce(status = 'new' AND score >= 65, false)) AS matched FROM seen""")
def _a9(spark, d):
    rows = seen(spark, d)
    marked = rows.withColumn("outcome", F.when(F.col("status") == "rejected_location", "url").otherwise("new"))
    return reports.run_stats(marked, marked.filter("outcome = 'new'"), 65)


@query("a10_source_summary", f"""WITH {RUN_LOG}, parts AS (
  SELECT run_id, 0 AS p, source, concat(source, ': ', n) AS t FROM run_log WHERE error IS NULL
  UNION ALL SELECT run_id, 1, source, concat(source, CASE WHEN regexp_matches(lower(error), '429|rate limit|too many requests') THEN ': rate-limited' ELSE ': FAILED' END)
    FROM run_log WHERE error IS NOT NULL
  UNION ALL SELECT run_id, 2, source, concat(source, ': DEGRADED') FROM run_log WHERE n % 4 = 0)
SELECT run_id, string_agg(t, ' | ' ORDER BY p, source) AS summary FROM parts GROUP BY run_id""")
def _a10(spark, d):
    report = run_log(spark, d).withColumns({"label": F.col("source"), "degraded": F.col("n") % 4 == 0})
    return reports.source_summary(report, "run_id")


_CLASSED = f"{OUTCOMES}, classed AS (SELECT *, {_STATUS} AS class FROM outcomes)"


def classed(spark, d):
    rows = outcomes(spark, d).withColumnRenamed("doc_id", "outcome_id")
    return rows.withColumn("class", cal.classify_status(F.col("status")))


@query("a11_outcome_summary", f"WITH {_CLASSED} SELECT class, count(*) AS n FROM classed GROUP BY 1")
def _a11(spark, d):
    return reports.outcome_summary(classed(spark, d))


@query("a12_context_block", f"""WITH {_CLASSED}, g AS (SELECT *, CASE WHEN class IN ('interviewing', 'offer') THEN 0
    WHEN class IN ('rejected', 'no_response') THEN 1 WHEN class = 'withdrawn' THEN 2 END AS grp FROM classed),
  r AS (SELECT *, row_number() OVER (ORDER BY grp, doc_id) AS rn, lag(grp) OVER (ORDER BY grp, doc_id) AS pg FROM g WHERE grp IS NOT NULL),
  l AS (SELECT rn, concat(CASE WHEN pg IS NULL OR pg <> grp THEN concat(CASE grp WHEN 0 THEN 'Converted' WHEN 1 THEN 'Applied and did not convert'
      ELSE 'Read and chose not to apply' END, ':', chr(10)) ELSE '' END,
    CASE WHEN rn <= 90 THEN concat('  - "', CASE WHEN company = '' THEN title WHEN title = '' THEN company ELSE concat(title, ' at ', company) END, '" -> ', status)
      ELSE concat('  - (+', (SELECT count(*) FROM r) - 90, ' more)') END) AS t FROM r WHERE rn <= 91)
SELECT concat((SELECT count(*) FROM classed), ' applications with a recorded outcome; ', (SELECT count(*) FROM g WHERE grp = 0),
  ' reached interview or offer.', chr(10), string_agg(t, chr(10) ORDER BY rn)) AS block FROM l""")
def _a12(spark, d):
    return reports.context_block(classed(spark, d), "outcome_id", 90)


# --- source health --------------------------------------------------------------------------

_PORTAL = """portal AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'jobbank' WHEN 1 THEN 'jobdanmark' ELSE 'jobnet' END AS site,
  CASE WHEN page_id % 3 = 1 THEN ' ' ELSE 'Acme' END AS company,
  CASE WHEN page_id % 7 = 0 THEN '<b>Lead</b>' ELSE 'Lead' END AS title FROM pages)"""
_OFF = "NOT regexp_matches(lower(regexp_extract(url, '://([^/:]+)', 1)), '(^|\\.)example\\.com$')"


@query("h1_degraded_reasons", f"""WITH {_PORTAL}, s AS (SELECT site, count(*) AS n, count(*) FILTER (trim(company) <> '') AS named,
  count(*) FILTER (regexp_matches(title, '<[a-zA-Z/]')) AS tagged, count(*) FILTER (site = 'jobbank' AND {_OFF}) AS off FROM portal GROUP BY 1)
SELECT site AS source, concat_ws('; ', CASE WHEN named = 0 THEN concat('no company on any of ', n, ' results') END,
  CASE WHEN tagged > 0 THEN concat('HTML tags in ', tagged, ' titles') END,
  CASE WHEN off > 0 THEN concat(off, ' links off the portal') END) AS reasons FROM s WHERE named = 0 OR tagged > 0 OR off > 0""")
def _h1(spark, d):
    found = health.degraded_reasons(derive(spark, d, _PORTAL, "portal"), {"jobbank": ("example.com",)})
    return found.select("source", F.array_join("reasons", "; ").alias("reasons"))


_KEPT = """kept AS (SELECT source, run_id, n, row_number() OVER (PARTITION BY source ORDER BY run_id DESC) AS rn FROM run_log
  WHERE error IS NULL QUALIFY rn <= 10)"""
_SILENT = """silent AS (SELECT source FROM kept GROUP BY source HAVING max(n) FILTER (rn <= 3) = 0 AND max(n) FILTER (rn > 3) > 0)"""


@query("h2_record_history", f"WITH {RUN_LOG}, {_KEPT} SELECT source, run_id, n FROM kept")
def _h2(spark, d):
    return health.record_history(run_log(spark, d)).select("source", "run_id", "n")


@query("h3_silent_sources", f"WITH {RUN_LOG}, {_KEPT}, {_SILENT} SELECT source FROM silent")
def _h3(spark, d):
    log = run_log(spark, d)
    ran = log.filter("run_id = DATE'2024-01-30' AND error IS NULL")
    return health.silent_sources(health.record_history(log), ran)


@query("h4_health_lines", f"""WITH {RUN_LOG}, {_KEPT}, {_SILENT}, {_PORTAL}
SELECT 0 AS part, source, concat(source, ' returned 0 jobs for 3 runs in a row. It returned jobs before, so the source may be blocked or its parser may be broken.') AS line FROM silent
UNION ALL SELECT 1, site, concat(site, ' output looks broken: HTML tags in ', count(*) FILTER (title <> 'Lead'), ' titles.')
FROM portal WHERE site <> 'jobdanmark' GROUP BY site
UNION ALL SELECT 1, site, concat(site, ' output looks broken: no company on any of ', count(*), ' results; HTML tags in ', count(*) FILTER (title <> 'Lead'), ' titles.')
FROM portal WHERE site = 'jobdanmark' GROUP BY site""")
def _h4(spark, d):
    log = run_log(spark, d)
    silent = health.silent_sources(health.record_history(log), log.filter("run_id = DATE'2024-01-30' AND error IS NULL"))
    return health.health_lines(silent, health.degraded_reasons(derive(spark, d, _PORTAL, "portal"), {}))


@query("h5_guard_flags", f"WITH {GUARD_ROWS} SELECT company AS source, count(*) FILTER (bad OR mixed <> '') AS flagged FROM found GROUP BY 1")
def _h5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("company"))
    rows = hostile(spark, d).join(docs, "doc_id").select(
        F.col("body").alias("title"), "company", F.col("body").alias("description")
    )
    return health.guard_flags(hygiene.guard(rows), "company")


# --- calibration ------------------------------------------------------------------------------

# The two lists of words without identity.
_TN = "'a','an','and','at','for','in','of','the','to','with','m','f','d','w','x','h'"
_CN = _TN + (
    ",'group','holding','holdings','company','co','corp','corporation','inc','incorporated','ltd','limited','llc','plc','ag','sa','se',"
    "'aps','ab','as','bv','nv','oy','gmbh','kg','denmark','danmark','nordic','nordics','scandinavia','international','global','europe','emea','part'"
)


def _w(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


def _tt(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({_w(x)}, lambda w: w NOT IN ({_TN}))))"


def _ct(x: str) -> str:
    kept = f"list_filter({_w(x)}, lambda w: length(w) > 1 AND w NOT IN ({_CN}))"
    return f"list_sort(list_distinct(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {_w(x)} END))"


@query("c1_classify_status", f"WITH {OUTCOMES} SELECT doc_id AS outcome_id, {_STATUS} AS class FROM outcomes")
def _c1(spark, d):
    return classed(spark, d).select("outcome_id", "class")


@query("c2_tokens", f"WITH {POSTINGS} SELECT pos, array_to_string({_tt('title')}, ' ') AS tokens FROM postings")
def _c2(spark, d):
    return postings(spark, d).select("pos", F.array_join(F.array_sort(cal.title_tokens(F.col("title"))), " ").alias("tokens"))


@query("c3_company_tokens", f"""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat(c_name, ' Group A/S')
  WHEN 1 THEN 'Global Holding A/S' WHEN 2 THEN '' ELSE concat('The ', c_mktsegment, ' Company') END AS name FROM customer)
SELECT c_custkey, array_to_string({_ct('name')}, ' ') AS tokens FROM c""")
def _c3(spark, d):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat("c_name", F.lit(" Group A/S"))).when(k == 1, "Global Holding A/S").when(k == 2, "").otherwise(
        F.concat(F.lit("The "), "c_mktsegment", F.lit(" Company"))
    )
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(cal.company_tokens(name)), " ").alias("tokens"))


_MATCHED = f"""{_CLASSED}, {SEEN},
  o AS (SELECT *, {_tt('title')} AS t, {_ct('company')} AS c FROM classed),
  s AS (SELECT job_id, score, first_seen, {_tt('title')} AS t, {_ct('company')} AS c FROM seen WHERE score IS NOT NULL),
  p AS (SELECT o.doc_id, s.job_id, s.score, s.first_seen, len(o.c) > 0 AND len(s.c) > 0 AS named, len(list_intersect(o.c, s.c)) > 0 AS agree,
    CAST(len(list_intersect(o.t, s.t)) AS DOUBLE) / (len(o.t) + len(s.t) - len(list_intersect(o.t, s.t))) AS sim
    FROM o JOIN s ON len(o.t) > 0 AND len(s.t) > 0),
  best AS (SELECT * FROM p WHERE sim >= 0.5 AND (agree OR (NOT named AND sim >= 0.9))
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, first_seen, job_id) = 1),
  matched AS (SELECT k.doc_id AS outcome_id, k.title, k.company, k.status, k.class, b.job_id, b.score, b.first_seen, round_even(b.sim, 2) AS similarity
    FROM classed k LEFT JOIN best b USING (doc_id))"""


def matched(spark, d):
    return cal.match_outcomes(classed(spark, d), seen(spark, d))


@query("c4_match_outcomes", f"WITH {_MATCHED} SELECT outcome_id, job_id, score, similarity FROM matched")
def _c4(spark, d):
    return matched(spark, d).select("outcome_id", "job_id", "score", "similarity")


@query("c5_band_of", f"""WITH {SEEN} SELECT job_id, CASE WHEN score >= 80 AND score < 101 THEN '80 to 100' WHEN score >= 70 AND score < 80 THEN '70 to 79'
  WHEN score >= 60 AND score < 70 THEN '60 to 69' WHEN score >= 50 AND score < 60 THEN '50 to 59' ELSE 'under 50' END AS band FROM seen WHERE score IS NOT NULL""")
def _c5(spark, d):
    return seen(spark, d).filter("score IS NOT NULL").select("job_id", cal.band_of(F.col("score")).alias("band"))


_TALKED = """(class IN ('interviewing', 'offer') OR regexp_matches(lower(status),
  'interview|video screen|phone screen|screening call|technical call|video call|onsite|round '))"""


@query("c6_reached_interview", f"WITH {_CLASSED} SELECT doc_id AS outcome_id, {_TALKED} AS talked FROM classed")
def _c6(spark, d):
    return classed(spark, d).select("outcome_id", cal.reached_interview(F.col("class"), F.col("status")).alias("talked"))


_TABLE = f"""{_MATCHED}, sent AS (SELECT * FROM matched WHERE score IS NOT NULL
    AND class IN ('applied', 'interviewing', 'offer', 'rejected', 'no_response')),
  tab AS (SELECT CASE WHEN score >= 80 THEN '80 to 100' WHEN score >= 70 THEN '70 to 79' WHEN score >= 60 THEN '60 to 69'
    WHEN score >= 50 THEN '50 to 59' ELSE 'under 50' END AS band, count(*) AS sent, count(*) FILTER ({_TALKED}) AS interviews,
    count(*) FILTER (class = 'offer') AS offers FROM sent GROUP BY 1)"""


@query("c7_calibration_table", f"""WITH {_TABLE} SELECT band, sent, interviews, offers, 100.0::DOUBLE * interviews / sent AS interview_rate,
  100.0::DOUBLE * offers / sent AS offer_rate FROM tab""")
def _c7(spark, d):
    return cal.calibration_table(matched(spark, d))


@query("c8_calibration_verdict", f"""WITH {_TABLE}, r AS (SELECT CAST(sum(sent) AS BIGINT) AS sent, count(*) AS bands,
  arg_max(100.0::DOUBLE * interviews / sent, CASE band WHEN 'under 50' THEN '0' ELSE band END)
  - arg_min(100.0::DOUBLE * interviews / sent, CASE band WHEN 'under 50' THEN '0' ELSE band END) AS spread FROM tab)
SELECT sent, bands, spread, CASE WHEN sent < 8 OR bands < 2 THEN 'insufficient' WHEN spread >= 15 THEN 'separating'
  WHEN spread <= -15 THEN 'inverted' ELSE 'flat' END AS verdict FROM r""")
def _c8(spark, d):
    return cal.calibration_verdict(cal.calibration_table(matched(spark, d)))


@query("c9_calibration_evidence", f"""WITH {_MATCHED} SELECT count(*) FILTER (score IS NOT NULL AND class = 'other') AS in_flight,
  count(*) FILTER (score IS NULL) AS unmatched, count(*) FILTER (score IS NOT NULL AND class = 'withdrawn') AS skipped,
  count(*) FILTER (score >= 70 AND class = 'withdrawn') AS skipped_above FROM matched""")
def _c9(spark, d):
    return cal.calibration_evidence(matched(spark, d))


@query("c9_weak_joins", f"WITH {_TABLE} SELECT outcome_id, similarity, title FROM sent WHERE similarity < 0.9")
def _c9b(spark, d):
    return cal.weak_joins(matched(spark, d), 0.9).select("outcome_id", "similarity", "title")


@query("w4_rolling_health", f"""WITH {RUN_LOG} SELECT run_id, source, coalesce(sum(n) OVER (PARTITION BY source ORDER BY run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 0
  AND max(n) OVER (PARTITION BY source ORDER BY run_id ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING) > 0, false) AS silent
FROM run_log WHERE error IS NULL""")
def _w4(spark, d):
    return health.rolling_health(run_log(spark, d))
