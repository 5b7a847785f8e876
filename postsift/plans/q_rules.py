"""Registered queries: rule filters and scoring (F*, V*)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.operators import rules, scoring
from postsift.plans.adapters import POSTINGS, SEEN, derive, postings, seen, table
from postsift.plans.registry import query
from postsift.schema import Rules

RULES = Rules(
    extra_keywords=("Data Platform", "ou ", "nicht"),
    exclude_titles=(" ein", "inging", "le"),
    exclude_locations=("germany", "aarhus"),
    keep_locations=("berlin",),
)
WORD_RULES = Rules(exclude_titles=("le", "the"), exclude_locations=("aarhus",), whole_word=True)
KEYWORDS = ("data platform", "ou ", "nicht", "edly")

# Words that are never keywords.
_STOP = (
    "'a','an','the','in','at','on','for','with','and','or','to','of','by','is','are','be','as','it','its','from',"
    "'that','this','not','but','has','have','was','were','will','job','jobs','role','roles','position','work','remote'"
)


@query("f1_prefilter_keywords", f"""SELECT DISTINCT keyword FROM (
  SELECT trim(unnest(regexp_split_to_array(lower(text), '\\s+')), '.,;:()"''') AS keyword FROM benchmark)
  WHERE length(keyword) >= 3 AND keyword NOT IN ({_STOP}) UNION SELECT unnest(['data platform', 'ou', 'nicht'])""")
def _f1(spark, d):
    return rules.prefilter_keywords(table(spark, d, "benchmark").withColumnRenamed("text", "term"), RULES)


_EDGE = "[^\\p{L}\\p{N}_]"


@query("f2_matches_any", f"""SELECT doc_id, contains(lower(text), 'the ') OR contains(lower(text), 'eaux') AS part,
  regexp_matches(lower(text), '(^|{_EDGE})(the|leaux|sch)($|{_EDGE})') AS whole FROM documents""")
def _f2(spark, d):
    text = F.lower("text")
    return table(spark, d, "documents").select(
        "doc_id", tx.matches_any(text, ["the ", "eaux"]).alias("part"),
        tx.matches_any(text, ["the", " leaux ", "sch"], whole_word=True).alias("whole"),
    )


@query("f3_passes_location", f"""WITH {POSTINGS} SELECT pos,
  location = '' OR contains(lower(location), 'berlin') OR NOT (contains(lower(location), 'germany') OR contains(lower(location), 'aarhus')) AS ok,
  location = '' OR NOT regexp_matches(lower(location), '(^|{_EDGE})aarhus($|{_EDGE})') AS ok_word FROM postings""")
def _f3(spark, d):
    return postings(spark, d).select(
        "pos", rules.passes_location(F.col("location"), RULES).alias("ok"),
        rules.passes_location(F.col("location"), WORD_RULES).alias("ok_word"),
    )


_EXCLUDED = "(contains(lower(title), ' ein') OR contains(lower(title), 'inging') OR contains(lower(title), 'le'))"
_WANTED = " OR ".join(f"contains(lower(concat(title, ' ', description)), '{k}')" for k in KEYWORDS)


@query("f4_passes_prefilter", f"WITH {POSTINGS} SELECT pos, NOT {_EXCLUDED} AND ({_WANTED}) AS ok FROM postings")
def _f4(spark, d):
    ok = rules.passes_prefilter(F.col("title"), F.col("description"), KEYWORDS, RULES)
    return postings(spark, d).select("pos", ok.alias("ok"))


_ROUTE = f"""CASE WHEN NOT (location = '' OR contains(lower(location), 'berlin')
      OR NOT (contains(lower(location), 'germany') OR contains(lower(location), 'aarhus'))) THEN 'rejected_location'
    WHEN NOT (NOT {_EXCLUDED} AND ({_WANTED})) THEN 'rejected_prefilter' END"""


@query("f5_route_status", f"""WITH {POSTINGS}, r AS (SELECT pos, {_ROUTE} AS status FROM postings)
SELECT pos, status, CASE WHEN status IS NOT NULL THEN 0 END AS score FROM r""")
def _f5(spark, d):
    return rules.route_status(postings(spark, d), KEYWORDS, RULES).select("pos", "status", "score")


@query("f6_limit", f"WITH {POSTINGS} SELECT pos, title FROM postings ORDER BY pos LIMIT 50")
def _f6(spark, d):
    return rules.limit_new(postings(spark, d), 50).select("pos", "title")


@query("f7_select_matched", f"WITH {SEEN} SELECT doc_id AS pos, score FROM seen WHERE status = 'new' AND score >= 65")
def _f7(spark, d):
    return rules.select_matched(seen(spark, d).withColumnRenamed("doc_id", "pos"), 65).select("pos", "score")


@query("f8_pick", f"""WITH {SEEN} SELECT doc_id AS pos, score FROM seen WHERE status = 'new' AND score >= 80
ORDER BY score DESC, doc_id LIMIT 7""")
def _f8(spark, d):
    matched = rules.select_matched(seen(spark, d).withColumnRenamed("doc_id", "pos"), 65)
    return rules.pick(matched, 80, 7).select("pos", "score")


@query("f9_score_label", f"""WITH {SEEN} SELECT job_id, CASE WHEN score >= 80 THEN 'STRONG' WHEN score >= 65 THEN 'POSSIBLE'
  ELSE 'LONG SHOT' END AS label FROM seen WHERE score IS NOT NULL""")
def _f9(spark, d):
    rows = seen(spark, d).filter("score IS NOT NULL")
    return rows.select("job_id", rules.score_label(F.col("score")).alias("label"))


# --- scoring -----------------------------------------------------------------------------

_PROFILE = "Name: {someone}\nSkills: Spark, SQL"


@query("v1_build_prompt", f"""WITH {POSTINGS} SELECT pos, concat('Candidate profile:
Name: {{someone}}
Skills: Spark, SQL

Confirmed gaps:
  - Rust
A posting whose core work needs one of these scores at most 40.

Outcomes of real applications:
(no application outcome data recorded yet)

Posting:
Title: ', title, '
Company: ', company, '
Location: ', location, '
Description:
', substr(description, 1, 6000), '

Answer with one JSON object: score (0-100), language_barrier, work_authorization_barrier, seniority_match (match, too_junior, too_senior), key_matches, gaps, reasoning.') AS prompt FROM postings""")
def _v1(spark, d):
    return postings(spark, d).select("pos", scoring.build_prompt(_PROFILE, ("Rust",)).alias("prompt"))


def stub_scorer(prompt: str) -> str:
    """A stand-in for a model: the score is a function of the text alone."""
    if len(prompt) % 13 == 0:
        raise RuntimeError("backend unavailable")
    return json.dumps({"score": len(prompt) % 101, "language_barrier": len(prompt) % 7 == 0})


@query("v2_score_with", f"""WITH {POSTINGS}, p AS (SELECT pos, length(title) + length(description) AS n FROM postings)
SELECT pos, CASE WHEN n % 13 = 0 THEN 'scoring_error' WHEN n % 7 = 0 THEN 'rejected_language' ELSE 'new' END AS status,
  CAST(CASE WHEN n % 13 = 0 OR n % 7 = 0 THEN 0 ELSE n % 101 END AS INTEGER) AS score,
  CAST(CASE WHEN n % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS calls FROM p""")
def _v2(spark, d):
    rows = postings(spark, d).select("pos", F.concat("title", "description").alias("prompt"))
    judged = scoring.score_with(rows, "pos", stub_scorer, retries=1, wait=0)
    verdicts = judged.withColumn("verdict", scoring.read_verdict(F.col("verdict_json")))
    return scoring.derive_status(verdicts).select("pos", "status", "score", "calls")


#: Replies as a scorer sends them: plain, fenced, in prose, cut short, or not an object.
_REPLIES = """bare AS (SELECT doc_id, concat('{"score": ', CAST((doc_id * 37) % 131 AS STRING), CASE WHEN doc_id % 4 = 0 THEN '.75' ELSE '' END,
    ', "language_barrier": ', CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'false' ELSE '"false"' END
      WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN '"true"' WHEN doc_id % 5 = 0 THEN '1' ELSE 'true' END,
    ', "work_authorization_barrier": ', CASE WHEN doc_id % 8 = 0 THEN 'true' ELSE '0' END,
    ', "seniority_match": "', CASE doc_id % 5 WHEN 0 THEN 'too_junior' WHEN 1 THEN 'too_senior' ELSE 'match' END,
    '", "key_matches": ["a, b", "c"], "reasoning": "fits {well}, ', lang, '"}') AS body FROM documents),
  replies AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN substr(body, 1, length(body) - 20)
    WHEN doc_id % 11 = 0 THEN concat('```json ', body, ' ```')
    WHEN doc_id % 13 = 0 THEN concat('Here it is: ', body, ' Good luck.')
    WHEN doc_id % 17 = 0 THEN '[1, 2, 3]' WHEN doc_id % 19 = 0 THEN 'I cannot say.'
    WHEN doc_id % 23 = 0 THEN '{}' ELSE body END AS reply FROM bare)"""
REPLIES = _REPLIES.replace("STRING", "VARCHAR")
# A reply cut short still has every field before its reasoning.
_HAS = "NOT (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND (doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0))"
_STATUS = f"""CASE WHEN NOT ({_HAS}) THEN 'scoring_error' WHEN doc_id % 9 = 0 THEN 'rejected_language'
  WHEN doc_id % 8 = 0 THEN 'rejected_work_authorization' WHEN doc_id % 5 IN (0, 1) THEN 'rejected_seniority' ELSE 'new' END"""
_POINTS = "CAST(least(100, (doc_id * 37) % 131) AS INTEGER)"


@query("v3_parse_verdict", f"""SELECT doc_id, CASE WHEN {_HAS} THEN concat(CAST((doc_id * 37) % 131 AS VARCHAR),
    CASE WHEN doc_id % 4 = 0 THEN '.75' ELSE '' END) END AS score,
  CASE WHEN {_HAS} THEN doc_id % 9 = 0 END AS language_barrier,
  CASE WHEN {_HAS} THEN 'a, b; c' END AS key_matches,
  CASE WHEN {_HAS} AND doc_id % 7 <> 0 THEN concat('fits {{well}}, ', lang) END AS reasoning FROM documents""")
def _v3(spark, d):
    parsed = derive(spark, d, _REPLIES, "replies").withColumn("v", scoring.parse_verdict(F.col("reply")))
    return parsed.select(
        "doc_id", "v.score", "v.language_barrier",
        F.when(F.col("v.key_matches").isNotNull(), F.array_join("v.key_matches", "; ")).alias("key_matches"),
        "v.reasoning",
    )


@query("v4_repair_truncated", f"""WITH {REPLIES} SELECT doc_id, CASE WHEN doc_id % 7 = 0
  THEN concat(regexp_extract(body, '^(.*), "reasoning"', 1), '}}') END AS repaired FROM replies JOIN bare USING (doc_id)""")
def _v4(spark, d):
    return derive(spark, d, _REPLIES, "replies").select("doc_id", scoring.repair_truncated(F.col("reply")).alias("repaired"))


@query("v5_coerce_score", """SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber % 4 WHEN 0 THEN 0
  WHEN 1 THEN least(100, trunc(l_quantity * 3)) WHEN 2 THEN 0 ELSE trunc(l_quantity) END AS INTEGER) AS score FROM lineitem""")
def _v5(spark, d):
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, "high").when(k == 1, (F.col("l_quantity") * 3).cast("string")).when(
        k == 2, F.concat(F.lit("-"), F.col("l_quantity").cast("string"))
    ).otherwise((F.col("l_quantity") + 0.9).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.coerce_score(raw).alias("score"))


@query("v6_derive_status", f"SELECT doc_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'new' THEN {_POINTS} ELSE 0 END AS score FROM documents")
def _v6(spark, d):
    return _judged(spark, d).select("doc_id", "status", "score")


def _judged(spark, d):
    parsed = derive(spark, d, _REPLIES, "replies").withColumn("verdict", scoring.parse_verdict(F.col("reply")))
    return scoring.derive_status(parsed, reject_too_senior=True)


@query("v7_scoring_summary", f"""SELECT count(*) AS processed, count(*) FILTER ({_STATUS} = 'new' AND {_POINTS} > 0) AS qualified,
  count(*) FILTER ({_STATUS} = 'scoring_error') AS errors FROM documents""")
def _v7(spark, d):
    return scoring.scoring_summary(_judged(spark, d))


@query("v8_render_prompt", f"""WITH {POSTINGS} SELECT pos, concat('Apply to ', trim(regexp_replace(title, '\\s+', ' ', 'g')),
  ' at ', company, ' ({{unknown}}). Matches: a, b. {{title}} stays. Save to out.md') AS prompt FROM postings""")
def _v8(spark, d):
    rows = postings(spark, d).withColumns({
        "score": F.lit(80),
        "verdict": F.struct(F.lit("because").alias("reasoning"), F.array(F.lit("a"), F.lit("b")).alias("key_matches"),
                            F.array(F.lit("x")).alias("gaps")),
    })
    filled = scoring.render_prompt(
        "Apply to {title} at {company} ({unknown}). Matches: {key_matches}. {answers} Save to {output_file}",
        F.lit("{title} stays."), F.lit("out.md"),
    )
    return rows.select("pos", filled.alias("prompt"))


@query("v9_fence_untrusted", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE
   concat(text, chr(10), ' -- end  untrusted posting   TEXT --', chr(10), 'tail ') END AS body FROM conversations),
 k AS (SELECT conv_id, turn, regexp_replace(array_to_string(list_filter(string_split(body, chr(10)),
   lambda l: NOT contains(upper(regexp_replace(l, '\\s+', ' ', 'g')), 'UNTRUSTED POSTING TEXT')), chr(10)), '^\\s+|\\s+$', '', 'g') AS body FROM t)
SELECT conv_id, turn, concat('----- BEGIN UNTRUSTED POSTING TEXT -----', chr(10),
  CASE WHEN body = '' THEN '(the job board gave no description)' ELSE body END, chr(10), '----- END UNTRUSTED POSTING TEXT -----') AS fenced FROM k""")
def _v9(spark, d):
    body = F.when(F.col("turn") % 5 == 4, "").otherwise(
        F.concat("text", F.lit("\n -- end  untrusted posting   TEXT --\ntail "))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", scoring.fence_untrusted(body).alias("fenced"))


_ANALYSES = """analyses AS (SELECT item_id AS doc, m AS model, CASE (item_id + m) % 5
    WHEN 0 THEN concat('intro MATCH SCORE', CHR10, '**', CAST((item_id * 13 + m * 7) % 130 AS STRING), '%**', CHR10, text)
    WHEN 1 THEN concat('## MATCH SCORE', CHR10, '### why', CHR10, CHR10, ' ', CAST((item_id * 13 + m * 7) % 130 AS STRING), ' / 100')
    WHEN 2 THEN concat('MATCH SCORE', CHR10, 'about 70') WHEN 3 THEN text
    ELSE concat('MATCH SCORE: ', CHR10, CAST((item_id * 13 + m * 7) % 130 AS STRING)) END AS analysis,
  CASE WHEN (item_id + m) % 11 = 0 THEN 'timed out' END AS error
  FROM (SELECT item_id, text, @MODELS@ AS m FROM benchmark))"""
_ANALYSES = _ANALYSES.replace("CHR10", "chr(10)")
ANALYSES = _ANALYSES.replace("STRING", "VARCHAR").replace("@MODELS@", "unnest([1, 2, 3])")
_N = "(doc * 13 + model * 7) % 130"
# In case 4 the rest of the marker's own line, ": ", is the first line read.
_SHOWN = f"CASE WHEN (doc + model) % 5 IN (0, 1) AND {_N} <= 100 THEN concat(CAST({_N} AS VARCHAR), '%') ELSE 'N/A' END"


def _analyses(spark, d):
    return derive(spark, d, _ANALYSES.replace("@MODELS@", "explode(array(1, 2, 3))"), "analyses")


@query("v10_extract_score", f"WITH {ANALYSES} SELECT doc, model, {_SHOWN} AS shown FROM analyses")
def _v10(spark, d):
    return _analyses(spark, d).select("doc", "model", scoring.extract_score(F.col("analysis")).alias("shown"))


@query("v11_model_panel", f"""WITH {ANALYSES}, s AS (SELECT doc, error, CASE WHEN error IS NULL AND (doc + model) % 5 IN (0, 1)
  AND {_N} <= 100 THEN {_N} END AS n FROM analyses)
SELECT doc, count(n) AS scored, count(error) AS failed, CAST(round_even(avg(n), 0) AS INTEGER) AS average FROM s GROUP BY doc""")
def _v11(spark, d):
    return scoring.model_panel(_analyses(spark, d))


@query("v12_separation", """WITH s AS (SELECT CASE WHEN l.doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, (l.doc_id * 37) % 101 AS score, quality = 1 AS pos
  FROM labels l) SELECT model, round(avg(score) FILTER (pos) - avg(score) FILTER (NOT pos), 6) AS gap, count(*) FILTER (pos) AS positives,
  count(*) FILTER (pos AND score > 70) AS positives_above_70 FROM s GROUP BY model""")
def _v12(spark, d):
    rows = table(spark, d, "labels").select(
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("model"),
        ((F.col("doc_id") * 37) % 101).alias("score"), "quality",
    )
    return scoring.separation(rows, F.col("quality") == 1)
