"""Registered queries: application records and patterns (P*, A13-A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.operators import applications as apps
from postsift.operators import reports
from postsift.plans.adapters import TODAY, derive, duck_text, table
from postsift.plans.q_ingest import _STATUS
from postsift.plans.registry import query
from postsift.schema import Family

_CLEAN = "trim(regexp_replace(regexp_replace(text, RX'[^A-Za-z ]', ''{g}), RX' +', ' '{g}))"
#: One application per labelled document: notes, a job text in one of several
#: layouts, and a coverage table, all built from the document and its labels.
_APPS = """base AS (SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic, @CLEAN@ AS words,
    CASE d.lang WHEN 'en' THEN 'Northwind' WHEN 'fr' THEN 'Contoso' WHEN 'de' THEN 'Fabrikam' ELSE 'Alder' END AS emp,
    CASE d.doc_id % 4 WHEN 0 THEN 'Senior Platform Engineer' WHEN 1 THEN 'Data Architect'
      WHEN 2 THEN 'Platforms Lead' ELSE 'Analyst' END AS job FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  applications AS (SELECT doc_id,
    concat(lower(emp), '-', replace(lower(job), ' ', '-'), '-', source, CASE WHEN doc_id % 23 = 0 THEN '' ELSE
      concat('-', CASE WHEN doc_id % 19 = 0 THEN '20241399' ELSE concat('202401', CASE WHEN doc_id % 28 < 9 THEN '0' ELSE '' END, CAST(1 + doc_id % 28 AS STRING)) END) END) AS folder,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE concat('# Notes', CHR10, '- **Status:** ',
      CASE WHEN doc_id % 10 = 0 THEN '' WHEN quality = 1 AND toxic = 1 THEN 'Offer, - ' WHEN quality = 0 AND toxic = 0 THEN 'rejected (see mail)'
        WHEN quality = 0 THEN 'Ghosted' WHEN doc_id % 11 = 0 THEN 'skipped' WHEN doc_id % 11 = 3 THEN 'drafting' ELSE 'applied  today' END,
      CASE WHEN doc_id % 3 = 0 THEN concat(CHR10, 'They did a video call first. ', words) ELSE '' END) END AS notes,
    CASE doc_id % 6 WHEN 0 THEN concat('**Company:** ', emp, ' (a Fabrikam company), Aarhus', CHR10, 'Role title: ', job)
      WHEN 1 THEN concat('intro', CHR10, '# Job description: ', emp, ' | ', job)
      WHEN 2 THEN concat('## ', job, ' - ', emp)
      WHEN 3 THEN concat('# ', job, ', ', source, ' (', emp, ')')
      WHEN 4 THEN concat('Company: not stated', CHR10, '# ', job)
      ELSE words END AS jd,
    concat('| JD requirement | Priority | Coverage |', CHR10, '|---|:--|---|', CHR10,
      '| **Skill', CAST(doc_id % 9 AS STRING), '** and ', source, ' experience | P0 | ', CASE doc_id % 4 WHEN 0 THEN 'Not  covered' WHEN 1 THEN 'weak' WHEN 2 THEN '**Not covered**' ELSE 'Covered' END, ' | x |', CHR10,
      'text', CHR10, '| ', lang, 'ish tools/', source, '. knowledge | P1 | ', CASE doc_id % 3 WHEN 0 THEN 'Not covered' WHEN 1 THEN 'Weakly' ELSE 'n/a' END, ' |', CHR10,
      '| two | cells |', CHR10) AS gap_analysis,
    doc_id % 5 <> 0 AS has_cv FROM base)"""
_APPS = _APPS.replace("CHR10", "chr(10)")
APPS = duck_text(_APPS.replace("@CLEAN@", _CLEAN.replace("{g}", ", 'g'"))).replace("STRING", "VARCHAR")
_APPS_SPARK = _APPS.replace("@CLEAN@", _CLEAN.replace("{g}", ""))


def applications(spark, d):
    return derive(spark, d, _APPS_SPARK, "applications")


def records(spark, d):
    return apps.collect_records(applications(spark, d), ("(see mail)",))


_RAW = "regexp_extract(notes, '(?im)^\\s*[-*]?\\s*\\*\\*Status:\\*\\*\\s*(.+)$', 1)"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, '(see mail)', ''), '\\s+', ' ', 'g'), ' -—–·,')"


_NOTE = f"""noted AS (SELECT *, nullif({_clean(_RAW)}, '') AS raw_status FROM applications),
  stated AS (SELECT *, CASE WHEN contains(lower(raw_status), 'reject') AND regexp_matches(lower({_clean('notes')}), 'interview|screen|round |technical call|video call')
    THEN 'rejected after interview' ELSE raw_status END AS status FROM noted)"""


@query("p1_status_from_notes", f"WITH {APPS}, {_NOTE} SELECT doc_id, status FROM stated")
def _p1(spark, d):
    return applications(spark, d).select("doc_id", apps.status_from_notes(F.col("notes"), ("(see mail)",)).alias("status"))


_EMP = """CASE lang WHEN 'en' THEN 'Northwind' WHEN 'fr' THEN 'Contoso' WHEN 'de' THEN 'Fabrikam' ELSE 'Alder' END"""
_COMPANY = f"""companies AS (SELECT a.doc_id, b.emp AS company,
  CASE a.doc_id % 6 WHEN 3 THEN concat(b.job, ', ', b.source)
    WHEN 5 THEN array_to_string(list_transform(string_split(regexp_replace(a.folder, '-[0-9]{{8}}$', ''), '-'),
      lambda w: concat(upper(w[1]), w[2:])), ' ')
    ELSE b.job END AS role FROM applications a JOIN base b USING (doc_id))"""


@query("p2_company_role", f"WITH {APPS}, {_COMPANY} SELECT * FROM companies")
def _p2(spark, d):
    return apps.company_role(applications(spark, d)).select("doc_id", "company", "role")


_STEM = "regexp_replace(folder, '-[0-9]{8}$', '')"
_DATE = "CAST(try_strptime(nullif(regexp_extract(folder, '-([0-9]{8})$', 1), ''), '%Y%m%d') AS DATE)"


@query("p3_folder_date_stem", f"WITH {APPS} SELECT doc_id, {_STEM} AS stem, {_DATE} AS day FROM applications")
def _p3(spark, d):
    return applications(spark, d).select(
        "doc_id", apps.folder_stem(F.col("folder")).alias("stem"), apps.folder_date(F.col("folder")).alias("day")
    )


_COVER = """cells AS (SELECT doc_id, folder, list_transform(string_split(regexp_extract(trim(line), '^\\|(.+)\\|\\s*$', 1), '|'),
    lambda c: trim(replace(c, '**', ''))) AS c FROM (SELECT doc_id, folder, unnest(string_split(gap_analysis, chr(10))) AS line FROM applications)
    WHERE regexp_matches(trim(line), '^\\|.+\\|\\s*$')),
  cover AS (SELECT doc_id, folder, c[1] AS requirement, c[2] AS priority, c[3] AS coverage FROM cells
    WHERE len(c) >= 3 AND NOT regexp_matches(c[1], '^[-: ]*$') AND NOT starts_with(lower(c[1]), 'jd requirement')),
  kinds AS (SELECT *, CASE WHEN regexp_matches(coverage, '(?i)not\\s*covered') THEN 'not covered' WHEN regexp_matches(coverage, '(?i)\\bweak') THEN 'weak'
    WHEN regexp_matches(coverage, '(?i)strongl|^covered|\\bfully\\b|transferable') THEN 'covered' END AS kind FROM cover)"""


@query("p4_coverage_rows", f"WITH {APPS}, {_COVER} SELECT folder, requirement, priority, coverage FROM cover")
def _p4(spark, d):
    return apps.coverage_rows(records(spark, d)).select("folder", "requirement", "priority", "coverage")


@query("p5_coverage_class", f"WITH {APPS}, {_COVER} SELECT folder, requirement, kind FROM kinds")
def _p5(spark, d):
    rows = apps.coverage_rows(records(spark, d))
    return rows.select("folder", "requirement", apps.coverage_class(F.col("coverage")).alias("kind"))


# Words that say nothing about a requirement.
_NOISE = (
    "'and','or','the','a','an','of','in','on','for','to','with','at','experience','years','strong','good','knowledge','skills','ability',"
    "'working','work','understanding','proven','solid','hands','level','plus','must','should','have','having','is','are','be','as','by',"
    "'e','g','eg','etc','via','from','into','across','within','using','role','team','teams','including','such','other','more','than',"
    "'requirement','requirements','p0','p1','p2','not','covered','hands-on','preferred','familiarity','familiar','advantage','bonus',"
    "'nice','ideally','desirable','equivalent','similar','related','relevant','deep','demonstrated','track','record','min','least'"
)


def _req(x: str) -> str:
    return (
        f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}][\\p{{L}}\\p{{N}}_+#/.-]*'), "
        f"lambda w: trim(w, './-')), lambda w: length(w) > 2 AND w NOT IN ({_NOISE})))"
    )


@query("p6_requirement_tokens", f"SELECT doc_id, array_to_string(list_sort({_req('text')}), ' ') AS tokens FROM documents")
def _p6(spark, d):
    tokens = F.array_sort(apps.requirement_tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(tokens, " ").alias("tokens"))


_GAPS = f"""terms AS (SELECT folder, kind, substr(requirement, 1, 70) AS example, unnest({_req('requirement')}) AS term FROM kinds WHERE kind IS NOT NULL),
  gaps AS (SELECT term, count(DISTINCT folder) FILTER (kind = 'not covered') AS not_covered_in, count(DISTINCT folder) FILTER (kind = 'weak') AS weak_in,
    min(example) FILTER (kind = 'not covered') AS example FROM terms GROUP BY term
    HAVING count(DISTINCT folder) FILTER (kind = 'not covered') >= 2 AND count(*) FILTER (kind = 'covered') = 0)"""


@query("p7_recurring_gaps", f"""WITH {APPS}, {_COVER}, {_GAPS} SELECT term, not_covered_in, weak_in, replace(example, '|', '/') AS example,
  greatest((SELECT count(*) FROM gaps) - 15, 0) AS hidden FROM gaps ORDER BY not_covered_in DESC, term LIMIT 15""")
def _p7(spark, d):
    return apps.recurring_gaps(records(spark, d))


# Title words that do not tell roles apart.
_GENERIC = (
    "'and','or','the','of','for','in','at','to','a','an','senior','junior','lead','staff','principal','head','chief','associate',"
    "'engineer','engineering','developer','specialist','consultant','manager','ii','iii','iv','i'"
)
_WORDS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9+#.]*'))"
_TELLING = f"list_filter({_WORDS}, lambda w: w NOT IN ({_GENERIC}) AND length(w) > 1)"


@query("p8_families_from_roles", f"""SELECT p_partkey, array_to_string(list_sort(CASE WHEN len({_TELLING.format(x='t')}) > 0 THEN {_TELLING.format(x='t')}
  ELSE {_WORDS.format(x='t')} END), ' ') AS terms FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Senior Engineer II' ELSE concat('Lead ', p_name) END AS t FROM part)""")
def _p8(spark, d):
    title = F.when(F.col("p_partkey") % 5 == 0, "Senior Engineer II").otherwise(F.concat(F.lit("Lead "), "p_name"))
    terms = F.array_sort(apps.derived_terms(title))
    return table(spark, d, "part").select("p_partkey", F.array_join(terms, " ").alias("terms"))


FAMILIES = [
    Family("Platform Engineer", ("platform",), require_all=True),
    *map(apps.declared_family, [{"name": "Data", "keywords": ["data architect", "analyst"]}, "architecture"]),
]
_FAM = """fam AS (SELECT doc_id, list_filter([CASE WHEN contains(lower(role), 'platform') THEN 'Platform Engineer' END,
   CASE WHEN contains(lower(role), 'data architect') OR contains(lower(role), 'analyst') THEN 'Data' END,
   CASE WHEN contains(lower(role), 'architect') THEN 'architecture' END], lambda x: x IS NOT NULL) AS names FROM companies)"""


@query("p9_families_for", f"WITH {APPS}, {_COMPANY}, {_FAM} SELECT doc_id, array_to_string(names, ', ') AS families FROM fam")
def _p9(spark, d):
    names = apps.families_for(F.col("role"), FAMILIES)
    return apps.company_role(applications(spark, d)).select("doc_id", F.array_join(names, ", ").alias("families"))


_RECORDS = f"""{APPS}, {_NOTE}, {_COMPANY}, records AS (SELECT s.doc_id, s.folder, s.has_cv, coalesce(s.status, '') AS status, c.company, c.role, {_DATE} AS day,
  CASE WHEN s.status IS NULL THEN 'unrecorded' ELSE {_STATUS} END AS class FROM stated s JOIN companies c USING (doc_id))"""
_SENT = "class IN ('applied', 'interviewing', 'offer', 'rejected', 'no_response')"


@query("p10_family_table", f"""WITH {_RECORDS}, {_FAM}, x AS (SELECT class, unnest(CASE WHEN len(names) > 0 THEN names ELSE ['unclassified'] END) AS family FROM records JOIN fam USING (doc_id))
SELECT family, count(*) AS total, count(*) FILTER ({_SENT}) AS sent, count(*) FILTER (class IN ('interviewing', 'offer')) AS interviewed,
  count(*) FILTER (class = 'withdrawn') AS withdrawn FROM x GROUP BY family""")
def _p10(spark, d):
    return apps.family_table(records(spark, d), FAMILIES)


@query("a13_funnel", f"""WITH {_RECORDS} SELECT list_position(['unrecorded', 'other', 'withdrawn', 'applied', 'interviewing', 'offer', 'rejected'], class)::BIGINT AS place,
  class, count(*) AS n FROM records WHERE class <> 'no_response' GROUP BY class""")
def _a13(spark, d):
    return reports.funnel(records(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("a13_funnel_totals", f"""WITH {_RECORDS} SELECT count(*) AS records, count(*) FILTER ({_SENT}) AS sent,
  count(*) FILTER (class IN ('unrecorded', 'other')) AS leaked, count(*) FILTER ({_SENT}) >= 8 AS rates_stated FROM records""")
def _a13b(spark, d):
    return reports.funnel_totals(records(spark, d))


@query("a14_stale", f"""WITH {_RECORDS} SELECT CAST(DATE'2024-01-30' - day AS INTEGER) AS age, folder, CASE WHEN status = '' THEN 'no status line' ELSE status END AS status
FROM records WHERE class IN ('other', 'unrecorded') AND has_cv AND DATE'2024-01-30' - day >= 21""")
def _a14(spark, d):
    return reports.stale(records(spark, d), TODAY)


@query("a15_nudge_lists", f"""WITH {_RECORDS}, n AS (SELECT *, CAST(coalesce(DATE'2024-01-30' - day, 0) AS INTEGER) AS age FROM records WHERE has_cv),
  r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY age DESC, folder) AS rn, count(*) OVER (PARTITION BY class) AS c
    FROM n WHERE class = 'unrecorded' OR (class = 'other' AND day IS NOT NULL AND age >= 10))
SELECT class AS list, age, folder, substr(concat(company, ' - ', role), 1, 70) AS label, greatest(c - 6, 0) AS hidden FROM r WHERE rn <= 6""")
def _a15(spark, d):
    return reports.nudge_lists(records(spark, d), TODAY, 10)


@query("a15_nudge_shortfall", f"WITH {_RECORDS} SELECT count(*) FILTER ({_SENT}) AS sent, greatest(8 - count(*) FILTER ({_SENT}), 0) AS short FROM records")
def _a15b(spark, d):
    return reports.nudge_shortfall(records(spark, d))


@query("a16_silent_records", f"""WITH {_RECORDS} SELECT r.folder, CASE WHEN a.notes IS NULL THEN 'no notes' ELSE 'no status line' END AS problem
FROM records r JOIN applications a USING (doc_id) WHERE r.status = ''""")
def _a16(spark, d):
    return reports.silent_records(records(spark, d))
