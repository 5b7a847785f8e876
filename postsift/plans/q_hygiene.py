"""Registered queries: record hygiene and keys (G*, N*)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.operators import hygiene
from postsift.plans.adapters import POSTINGS, derive, postings, table
from postsift.plans.registry import query

# --- SQL twins of the text functions ------------------------------------------------

NOISE = "('a','s','as','aps','ab','ltd','llc','gmbh','inc','corp','co','denmark','danmark','dk','group')"


def n1(x: str) -> str:
    folded = f"replace(replace(replace(coalesce({x},''),'æ','ae'),'Æ','ae'),'ß','')"
    folded = f"translate({folded}, 'øØåÅ', 'ooaa')"
    plain = f"regexp_replace(strip_accents({folded}), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(lower({plain}), '[^a-z0-9]+', ' ', 'g'))"


def title_key(x: str) -> str:
    return n1(f"regexp_replace({x}, '[\\(\\[][^\\)\\]]*[\\)\\]]', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def company_key(x: str) -> str:
    return f"array_to_string(list_filter(string_split({n1(x)}, ' '), lambda w: w <> '' AND w NOT IN {NOISE}), ' ')"


def head(x: str) -> str:
    w = words(n1(x))
    return f"CASE WHEN len({w}) >= 30 THEN array_to_string({w}[1:3000], ' ') ELSE '' END"


def loose(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    )


KEYED = (
    POSTINGS
    + f""", keyed AS (SELECT *, {company_key('company')} AS company_key, {title_key('title')} AS title_key,
  {head('description')} AS desc_head FROM postings)"""
)

# --- hostile text: characters injected by position, the same on both sides -----------------

_HOSTILE = """hostile AS (SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN concat('Pyt', CHR(8203), 'hon ', text)
  WHEN 1 THEN concat('Senior ', CHR(8238), text)
  WHEN 2 THEN concat('Java', CHR(8203), ' developer ', text)
  WHEN 3 THEN concat('Work at ', CHR(1040), 'pple and ', CHR(945), 'cme ', text)
  WHEN 4 THEN concat('Soft', CHR(173), 'ware ', text)
  ELSE text END AS body FROM documents)"""
HOSTILE = _HOSTILE.replace("CHR(", "chr(")
_INV = "[\\x{00AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2069}\\x{FEFF}]"
_WC = "[\\p{L}\\p{N}_]"


def hostile(spark, d):
    # Spark's chr() stops at 255, so the characters are written out.
    text = re.sub(r"CHR\((\d+)\)", lambda m: f"'{chr(int(m[1]))}'", _HOSTILE)
    return derive(spark, d, text, "hostile")


@query("g1_clean_invisible", f"""WITH {HOSTILE}
SELECT doc_id, regexp_replace(body, '{_INV}', '', 'g') AS cleaned,
  CAST(length(body) - length(regexp_replace(body, '{_INV}', '', 'g')) AS BIGINT) AS removed FROM hostile""")
def _g1(spark, d):
    return hostile(spark, d).select(
        "doc_id",
        tx.clean_invisible(F.col("body")).alias("cleaned"),
        tx.invisible_count(F.col("body")).cast("long").alias("removed"),
    )


_TAMPER = (
    f"regexp_matches({{x}}, '[\\x{{{{202A}}}}-\\x{{{{202E}}}}\\x{{{{2066}}}}-\\x{{{{2069}}}}]|"
    f"{_WC.replace('{', '{{').replace('}', '}}')}[\\x{{{{200B}}}}-\\x{{{{200D}}}}\\x{{{{2060}}}}\\x{{{{FEFF}}}}]"
    f"{_WC.replace('{', '{{').replace('}', '}}')}')"
)


@query("g2_tampering", f"WITH {HOSTILE} SELECT doc_id, {_TAMPER.format(x='body')} AS tampered FROM hostile")
def _g2(spark, d):
    return hostile(spark, d).select("doc_id", tx.tampering(F.col("body")).alias("tampered"))


def _lookalikes(x: str) -> str:
    cleaned = f"regexp_replace({x}, '{_INV}', '', 'g')"
    return (
        f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({cleaned}, '{_WC}+'), "
        "lambda w: regexp_matches(w, '[A-Za-z\\x{00C0}-\\x{024F}]') AND regexp_matches(w, '[\\x{0370}-\\x{04FF}]')))), ', ')"
    )


@query("g3_lookalikes", f"WITH {HOSTILE} SELECT doc_id, {_lookalikes('body')} AS mixed FROM hostile")
def _g3(spark, d):
    return hostile(spark, d).select(
        "doc_id", F.array_join(tx.lookalikes(F.col("body")), ", ").alias("mixed")
    )


GUARD_ROWS = f"""{HOSTILE}, rows AS (SELECT h.doc_id, body AS title, source AS company,
  body AS description FROM hostile h JOIN documents USING (doc_id)),
 found AS (SELECT *, length(concat(title, company, description))
     - length(regexp_replace(concat(title, company, description), '{_INV}', '', 'g')) AS n,
   {_TAMPER.format(x='title')} OR {_TAMPER.format(x='company')} OR {_TAMPER.format(x='description')} AS bad,
   {_lookalikes("concat(title, ' ', company, ' ', description)")} AS mixed FROM rows)"""


@query("g4_guard", f"""WITH {GUARD_ROWS}
SELECT doc_id, regexp_replace(title, '{_INV}', '', 'g') AS title,
  length(regexp_replace(description, '{_INV}', '', 'g')) AS description_chars,
  CASE WHEN bad OR mixed <> '' THEN concat('flagged: ', concat_ws('; ',
      CASE WHEN bad THEN 'bidi control or zero-width character inside a word' END,
      CASE WHEN mixed <> '' THEN concat('look-alike words: ', mixed) END,
      CASE WHEN n > 0 THEN concat(n, ' invisible characters removed') END))
    WHEN n > 0 THEN concat('cleaned: ', n, ' invisible characters removed') ELSE 'clean' END AS guard
FROM found""")
def _g4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("company"))
    rows = hostile(spark, d).join(docs, "doc_id").select(
        "doc_id", F.col("body").alias("title"), "company", F.col("body").alias("description")
    )
    return hygiene.guard(rows).select(
        "doc_id", "title", F.length("description").cast("long").alias("description_chars"), "guard"
    )


@query("n1_normalize_text", f"SELECT doc_id, {n1('text')} AS folded FROM documents")
def _n1(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("folded"))


_TITLED = """titled AS (SELECT doc_id, concat(text, ' (', source, '-', CAST(doc_id AS STRING),
  ') [', lang, '] Straße') AS title FROM documents)"""


def titled(spark, d):
    return derive(spark, d, _TITLED, "titled")


@query("n2_title_key", f"WITH {_TITLED} SELECT doc_id, {title_key('title')} AS title_key FROM titled")
def _n2(spark, d):
    return titled(spark, d).select("doc_id", tx.title_key(F.col("title")).alias("title_key"))


@query("n3_company_key", f"WITH {POSTINGS} SELECT pos, {company_key('company')} AS company_key FROM postings")
def _n3(spark, d):
    return postings(spark, d).select("pos", tx.company_key(F.col("company")).alias("company_key"))


@query("n4_content_key", f"""WITH {KEYED} SELECT pos, CASE WHEN title_key <> '' AND company_key <> ''
  THEN concat(title_key, '|', company_key) ELSE '' END AS content_key FROM keyed""")
def _n4(spark, d):
    return postings(spark, d).select(
        "pos", tx.content_key(F.col("title"), F.col("company")).alias("content_key")
    )


@query("n5_loose_key", f"""WITH {POSTINGS} SELECT pos, concat({loose('title')}, '|', {loose('company')}) AS loose_key
FROM postings""")
def _n5(spark, d):
    return postings(spark, d).select("pos", tx.loose_key(F.col("title"), F.col("company")).alias("loose_key"))


@query("n6_title_words", f"""WITH {_TITLED} SELECT doc_id,
  array_to_string(list_sort(list_distinct({words(title_key('title'))})), ' ') AS words FROM titled""")
def _n6(spark, d):
    return titled(spark, d).select(
        "doc_id", F.array_join(F.array_sort(tx.title_words(F.col("title"))), " ").alias("words")
    )


@query("n7_description_head", f"SELECT doc_id, {head('text')} AS head FROM documents")
def _n7(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.description_head(F.col("text")).alias("head"))


_RUNS = """list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i+1], ' ', w[i+2]))"""


@query("n8_shingles", f"""WITH h AS (SELECT doc_id, {words(head('text'))} AS w FROM documents)
SELECT doc_id, CAST(len(list_distinct(CASE WHEN len(w) >= 3 THEN {_RUNS} ELSE [] END)) AS BIGINT) AS n_runs,
  coalesce(list_min(CASE WHEN len(w) >= 3 THEN {_RUNS} ELSE [] END), '') AS first_run FROM h""")
def _n8(spark, d):
    runs = tx.shingles(tx.description_head(F.col("text")))
    return table(spark, d, "documents").select("doc_id", runs.alias("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.coalesce(F.array_min("runs"), F.lit("")).alias("first_run"),
    )


@query("n9_jaccard", f"""WITH s AS (SELECT doc_id, list_distinct({words(n1('text'))}) AS a,
  list_distinct({words(n1('substr(text, 200)'))}) AS b FROM documents)
SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE
  round(CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))), 9) END AS similarity
FROM s""")
def _n9(spark, d):
    a = F.array_distinct(tx.words_of(tx.normalize_text(F.col("text"))))
    b = F.array_distinct(tx.words_of(tx.normalize_text(F.substr("text", F.lit(200)))))
    sets = table(spark, d, "documents").select("doc_id", a.alias("a"), b.alias("b"))
    return sets.select("doc_id", F.round(tx.jaccard(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("n10_make_job_id", f"WITH {POSTINGS} SELECT pos, substr(sha256(url), 1, 16) AS job_id FROM postings")
def _n10(spark, d):
    return postings(spark, d).select("pos", tx.job_id(F.col("url")).alias("job_id"))


@query("n11_slug", f"""WITH {POSTINGS} SELECT pos, substr(trim(regexp_replace(lower(concat_ws('-', '2024-01-30', company,
  coalesce(nullif(title, ''), 'role'))), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120) AS slug FROM postings""")
def _n11(spark, d):
    return postings(spark, d).select(
        "pos", tx.slug(F.lit("2024-01-30"), F.col("company"), F.col("title")).alias("slug")
    )


@query("n12_one_line", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations")
def _n12(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.one_line(F.col("text")).alias("line"))


@query("n13_flat", """SELECT conv_id, turn, replace(lower(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))),
  'ß', 'ss') AS flat FROM conversations""")
def _n13(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.flat(F.col("text")).alias("flat"))
