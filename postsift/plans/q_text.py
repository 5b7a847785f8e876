"""Registered queries: redaction, scans and text quality (R*, Q*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.operators import quality, sensitive
from postsift.plans.adapters import derive, duck_text, table
from postsift.plans.q_hygiene import company_key
from postsift.plans.registry import ORACLES, query

# Credential shapes are put together from pieces, so none is stored as such.
_A = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef0123456789"
_PLANTED = f"""planted AS (SELECT doc_id, concat(text, chr(10), CASE doc_id % 9
   WHEN 0 THEN concat('key gh', 'p_{_A}') WHEN 1 THEN concat('x github', '_pat_{_A}A') WHEN 2 THEN concat('AI', 'za{_A} end')
   WHEN 3 THEN concat('apify', '_api_{_A}') WHEN 4 THEN concat('s', 'k-{_A}') WHEN 5 THEN concat('bot 123456', '789:{_A}')
   WHEN 6 THEN concat('Authorization: Bea', 'rer {_A}') WHEN 7 THEN concat('GET /x?tok', 'en={_A}&a=1')
   ELSE concat('https://user:pass', 'word@host/ AKIA', 'ABCDEFGHIJKLMNOP') END,
   CASE WHEN doc_id % 4 = 0 THEN ' pre-push-check: allow' ELSE '' END, chr(10), '-----BEGIN RSA PRI', 'VATE KEY-----') AS body FROM documents)"""


def planted(spark, d):
    return derive(spark, d, _PLANTED, "planted")


def _redact(x: str) -> str:
    for pattern, with_ in (
        ("gh[pousr]_[A-Za-z0-9]{16,}", "***REDACTED***"), ("github_pat_[A-Za-z0-9_]{20,}", "***REDACTED***"),
        ("AIza[A-Za-z0-9_\\-]{20,}", "***REDACTED***"), ("apify_api_[A-Za-z0-9]{20,}", "***REDACTED***"),
        ("sk-[A-Za-z0-9_\\-]{20,}", "***REDACTED***"), ("\\b\\d{6,12}:[A-Za-z0-9_\\-]{30,}", "***REDACTED***"),
        ("(?i)(bearer\\s+)[A-Za-z0-9._\\-]{16,}", "\\1***REDACTED***"),
        ("(?i)([?&](?:token|api_?key|access_token)=)[^&\\s]+", "\\1***REDACTED***"),
        ("://[^/\\s:@]+:[^/\\s@]+@", "://***REDACTED***@"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{with_}', 'g')"
    return x


@query("r1_redact", f"WITH {_PLANTED} SELECT doc_id, {_redact('body')} AS body FROM planted")
def _r1(spark, d):
    return planted(spark, d).select("doc_id", sensitive.redact(F.col("body")).alias("body"))


_SHAPES = (
    ("GitHub token", "\\bgh[pousr]_[A-Za-z0-9]{30,}\\b"), ("GitHub fine-grained token", "\\bgithub_pat_[A-Za-z0-9_]{40,}\\b"),
    ("Google API key", "\\bAIza[A-Za-z0-9_\\-]{30,}\\b"), ("Apify token", "\\bapify_api_[A-Za-z0-9]{25,}\\b"),
    ("OpenAI-style key", "\\bsk-[A-Za-z0-9_\\-]{30,}\\b"), ("Telegram bot token", "\\b\\d{8,12}:[A-Za-z0-9_\\-]{33,}\\b"),
    ("private key block", "-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("password in a URL", "://[^/\\s:@]+:[^/\\s@]{3,}@"),
    ("AWS access key", "\\bAKIA[0-9A-Z]{16}\\b"),
)
_SECRETS = " UNION ALL ".join(
    f"SELECT path, line, '{label}' AS label, regexp_extract(content, '{p}', 0) AS m FROM lines" for label, p in _SHAPES
)


def _lines(source: str, path: str, text: str) -> str:
    return (
        f"lines AS (SELECT path, CAST(i AS BIGINT) AS line, parts[i] AS content FROM (SELECT {path} AS path, string_split({text}, chr(10)) AS parts, "
        f"unnest(generate_series(1, len(string_split({text}, chr(10))))) AS i FROM {source}))"
    )


@query("r2_scan_secrets", f"""WITH {_PLANTED}, {_lines('planted', 'doc_id', 'body')}, hits AS ({_SECRETS})
SELECT path, h.line, label, concat(substr(m, 1, 12), '...', right(m, 4)) AS evidence FROM hits h JOIN lines l USING (path, line)
WHERE m <> '' AND NOT contains(l.content, 'pre-push-check: allow')""")
def _r2(spark, d):
    return sensitive.scan_secrets(sensitive.lines_of(planted(spark, d), "doc_id", "body"))


_PATHS = """paths AS (SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a/b/' WHEN 2 THEN 'applications/' ELSE 'x/data/' END,
  CASE page_id % 14 WHEN 0 THEN '.env' WHEN 1 THEN '.env.local' WHEN 2 THEN '.env.example' WHEN 3 THEN 'config.yaml' WHEN 4 THEN 'profile.yaml'
   WHEN 5 THEN 'outcomes.csv' WHEN 6 THEN 'jobs.db' WHEN 7 THEN 'denylist.txt' WHEN 8 THEN 'VM.md' WHEN 9 THEN 'my.KEY' WHEN 10 THEN 'id_rsa'
   WHEN 11 THEN 'readme.md' WHEN 12 THEN 'privacy.txt' ELSE '.env.examples' END) AS path FROM pages)"""


@query("r3_forbidden_paths", f"""WITH {_PATHS} SELECT page_id, path, CASE WHEN regexp_matches(path, '(^|/)\\.env$') THEN 'real secrets'
  WHEN regexp_matches(path, '(^|/)\\.env\\.') AND NOT regexp_matches(path, '(^|/)\\.env\\.example$') THEN 'real secrets'
  WHEN path = 'config.yaml' THEN 'your own config, gitignored on purpose' WHEN path = 'profile.yaml' THEN 'your own profile, gitignored on purpose'
  WHEN regexp_matches(path, '(^|/)outcomes\\.csv$') THEN 'your application history' WHEN regexp_matches(path, '(^|/)jobs\\.db$') THEN 'your seen-jobs database'
  WHEN regexp_matches(path, '(^|/)(privacy|denylist)\\.txt$') THEN 'your private word list' WHEN starts_with(path, 'applications/') THEN 'your own application folders'
  WHEN regexp_matches(path, '(^|/)data/') THEN 'run output' WHEN regexp_matches(path, '(?i)(^|/)vm\\.md$') THEN 'infrastructure notes'
  WHEN regexp_matches(path, '(?i)\\.(pem|key|ppk|p12|pfx)$') OR regexp_matches(path, '(?i)(^|/)id_(rsa|ed25519|ecdsa)$') THEN 'a private key' END AS reason FROM paths""")
def _r3(spark, d):
    return derive(spark, d, _PATHS, "paths").select("page_id", "path", sensitive.forbidden_path(F.col("path")).alias("reason"))


_IDENT = """idents AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'employer' WHEN 1 THEN 'phone' WHEN 2 THEN 'email' WHEN 3 THEN 'place' WHEN 4 THEN 'repo' ELSE 'keyfile' END AS kind,
  CASE doc_id % 6 WHEN 0 THEN concat('Firm', source, ' Denmark A/S') WHEN 1 THEN concat('+45 12 34 ', CAST(1000 + doc_id AS STRING)) WHEN 2 THEN concat(source, '.x@mail.example')
   WHEN 3 THEN concat('Øst', source, 'ø') WHEN 4 THEN concat('org/', source, 'repo') ELSE concat(source, 'key.pem') END AS value FROM documents)"""


@query("r4_term_variants", f"""WITH {_IDENT.replace('STRING', 'VARCHAR')} SELECT doc_id, CASE kind
  WHEN 'employer' THEN concat(lower(value), ', firm', substr(value, 5, strpos(value, ' ') - 5)) WHEN 'phone' THEN concat(value, ', ', replace(value, ' ', ''), ', ', substr(replace(value, ' ', ''), 2))
  WHEN 'email' THEN concat(value, ', ', split_part(value, '@', 1)) WHEN 'repo' THEN concat(value, ', ', split_part(value, '/', 2)) WHEN 'keyfile' THEN concat(value, ', ', split_part(value, '.', 1))
  ELSE concat(lower(value), ', ', replace(lower(value), 'ø', 'oe'), ', ', replace(lower(value), 'ø', 'o')) END AS variants FROM idents""")
def _r4(spark, d):
    variants = sensitive.term_variants(F.col("kind"), F.col("value"))
    return derive(spark, d, _IDENT, "idents").select("doc_id", F.array_join(variants, ", ").alias("variants"))


_TERMS = """terms AS (SELECT CAST(row_number() OVER (ORDER BY item_id) AS BIGINT) AS entry, lower(regexp_extract(text, RX'^(\\S+\\s+\\S+\\s+\\S+)', 1)) AS term FROM benchmark)"""


def terms(spark, d):
    return derive(spark, d, _TERMS, "terms")


_SCAN = f"""WITH {duck_text(_TERMS)}, {_lines('documents', 'doc_id', 'text')}
SELECT path, line, CAST(strpos(lower(content), term) AS BIGINT) AS col, entry FROM lines JOIN terms ON contains(lower(content), term)"""


@query("r5_scan_terms", _SCAN)
def _r5(spark, d):
    return sensitive.scan_terms(sensitive.lines_of(table(spark, d, "documents"), "doc_id", "text"), terms(spark, d))


@query("r5_scan_terms_long_list", _SCAN)
def _r5b(spark, d):
    lines = sensitive.lines_of(table(spark, d, "documents"), "doc_id", "text")
    return sensitive.scan_terms(lines, terms(spark, d), block_chars=300)


@query("r6_scan_tree", f"""WITH {duck_text(_TERMS)}, {_lines('documents', 'doc_id', 'text')}, f AS (SELECT *, concat('d/', path, CASE path % 10 WHEN 0 THEN '.PNG' WHEN 1 THEN '.zip' WHEN 2 THEN '/terms.txt' ELSE '.txt' END) AS name FROM lines)
SELECT name AS path, line, CAST(strpos(lower(content), term) AS BIGINT) AS col, entry FROM f JOIN terms ON contains(lower(content), term)
WHERE path % 10 > 3""")
def _r6(spark, d):
    k = F.col("doc_id") % 10
    suffix = F.when(k == 0, ".PNG").when(k == 1, ".zip").when(k == 2, "/terms.txt").otherwise(".txt")
    # Every tenth file holds a NUL and reads as binary.
    content = F.encode(F.concat("text", F.when(k == 3, "\x00").otherwise("")), "UTF-8")
    files = table(spark, d, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.length(content).cast("long").alias("length"), content.alias("content"),
    )
    return sensitive.scan_files(files, terms(spark, d), "terms.txt")


_LISTS = """lists AS (SELECT 0 AS list_no, 'first.txt' AS source, item_id AS line_no, CASE WHEN item_id % 5 = 0 THEN '# note' WHEN item_id % 7 = 0 THEN ' ' ELSE concat(' ', text, ' ') END AS text FROM benchmark
  UNION ALL SELECT 1, 'second.txt', doc_id, text FROM documents)"""


@query("r7_term_merge", f"""WITH {_LISTS}, t AS (SELECT *, trim(lower(text)) AS term FROM lists), p AS (SELECT list_no, source, term, line_no,
  CAST(row_number() OVER (PARTITION BY list_no ORDER BY line_no) AS INTEGER) AS position FROM t WHERE term <> '' AND NOT starts_with(term, '#'))
SELECT list_no, source, position, term FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY list_no, line_no) = 1""")
def _r7(spark, d):
    return sensitive.term_merge(derive(spark, d, _LISTS, "lists"))


@query("r8_scan_identities", f"""WITH {duck_text(_TERMS)} SELECT doc_id AS id, 'text' AS field, min(entry) AS entry
FROM documents JOIN terms ON contains(lower(text), term) GROUP BY 1 UNION ALL
SELECT conv_id * 1000 + turn, role, min(entry) FROM conversations JOIN terms ON contains(lower(text), term) GROUP BY 1, 2""")
def _r8(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("field"), "text")
    convs = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("field"), "text"
    )
    return sensitive.scan_identities(docs.unionByName(convs), terms(spark, d))


_DIFFS = """diffs AS (SELECT doc_id, concat('diff --git', chr(10), '--- a/f.txt', chr(10), '+++ b/f', source, '.txt', chr(10), '@@ -1,0 +', CAST(10 + doc_id % 5 AS STRING), ',9 @@ ctx', chr(10),
  '+', replace(text, chr(10), concat(chr(10), '+')), chr(10), '-gone', chr(10), '@@ -90 +100 @@', chr(10), '+', text, chr(10), '+++ /dev/null', chr(10), '@@ -1 +0,0 @@', chr(10), '+', text) AS body FROM documents)"""
_DIFF_LINES = f"""{_DIFFS.replace('STRING', 'VARCHAR')}, {_lines('documents', 'doc_id', 'text')},
  added AS (SELECT path AS doc_id, concat('f', source, '.txt') AS path, 10 + doc_id % 5 + line - 1 AS line, content FROM lines JOIN documents ON doc_id = path
    UNION ALL SELECT path, concat('f', source, '.txt'), 100, content FROM lines JOIN documents ON doc_id = path WHERE line = 1)"""


@query("r9_scan_added_lines", f"""WITH {duck_text(_TERMS)}, {_DIFF_LINES}
SELECT doc_id, path, line, CAST(strpos(lower(content), term) AS BIGINT) AS col, entry FROM added JOIN terms ON contains(lower(content), term)""")
def _r9(spark, d):
    return sensitive.scan_added_lines(derive(spark, d, _DIFFS, "diffs"), "doc_id", "body", terms(spark, d))


@query("r9_added_lines", f"WITH {_DIFF_LINES} SELECT * FROM added")
def _r9b(spark, d):
    return sensitive.added_lines(derive(spark, d, _DIFFS, "diffs"), "doc_id", "body")


@query("r10_employers_not_listed", f"""WITH c AS (SELECT DISTINCT concat('Firm ', source, ' Østerby A/S') AS company FROM documents),
 t AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN concat('firm ', source, ' osterby') WHEN 1 THEN 'nothing' ELSE concat('m ', source, ' ø') END AS term FROM documents WHERE lang = 'de' AND source NOT IN ('src3', 'src7', 'src11')),
 dec AS (SELECT DISTINCT concat('firm ', source, ' østerby a/s') AS low FROM documents WHERE lang = 'es' AND n_chars > 5000)
SELECT company FROM c WHERE lower(company) NOT IN (SELECT low FROM dec) AND {company_key('company')} NOT IN (SELECT term FROM t)
  AND NOT EXISTS (SELECT 1 FROM t WHERE contains(lower(company), term))""")
def _r10(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 3
    term = F.when(k == 0, F.concat(F.lit("firm "), "source", F.lit(" osterby"))).when(k == 1, "nothing").otherwise(
        F.concat(F.lit("m "), "source", F.lit(" ø"))
    )
    listed = docs.filter("lang = 'de' AND source NOT IN ('src3', 'src7', 'src11')").select(term.alias("term")).distinct().withColumn("entry", F.xxhash64("term"))
    declined = docs.filter("lang = 'es' AND n_chars > 5000").select(
        F.concat(F.lit("firm "), "source", F.lit(" østerby a/s")).alias("company")
    )
    companies = docs.select(F.concat(F.lit("Firm "), "source", F.lit(" Østerby A/S")).alias("company"))
    return sensitive.employers_not_listed(companies, listed, declined)


# --- text quality ---------------------------------------------------------------------------

_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _check(rows, key, check):
    return rows.select(key, check.alias("c")).select(key, "c.verdict", "c.detail")


@query("q1_check_text_layer", f"""WITH s AS (SELECT conv_id AS doc, CAST(sum(length({_STRIP})) AS BIGINT) AS n FROM conversations GROUP BY 1)
SELECT doc, CASE WHEN n >= 800 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN n >= 800 THEN concat(n, ' characters extracted')
  ELSE concat('only ', n, ' characters extracted, expected at least 800') END AS detail FROM s""")
def _q1(spark, d):
    stats = quality.page_stats(table(spark, d, "conversations").withColumnRenamed("conv_id", "doc"))
    return _check(stats, "doc", quality.check_text_layer(F.col("chars")))


@query("q2_check_pages", """WITH s AS (SELECT conv_id AS doc, count(*) AS n FROM conversations GROUP BY 1)
SELECT doc, CASE WHEN n <= 2 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN n <= 2 THEN concat(n, ' page(s)') ELSE concat(n, ' pages, limit is 2') END AS detail FROM s""")
def _q2(spark, d):
    stats = quality.page_stats(table(spark, d, "conversations").withColumnRenamed("conv_id", "doc"))
    return _check(stats, "doc", quality.check_pages(F.col("pages")))


#: Documents with what a reader would expect to find in them.
_CV = """cv AS (SELECT doc_id, n_chars, CASE doc_id % 4 WHEN 0 THEN 'Jane  Østerby' WHEN 1 THEN 'Kim Ny' ELSE NULL END AS name,
  CASE doc_id % 3 WHEN 0 THEN NULL ELSE 'jane@mail.example' END AS email, CASE doc_id % 5 WHEN 0 THEN NULL ELSE '+45 12 34 56 78' END AS phone,
  concat(CASE WHEN doc_id % 4 = 0 AND doc_id % 7 = 0 THEN concat(substr(text, 1, 400), ' ') ELSE '' END, CASE WHEN doc_id % 8 < 4 THEN concat('JANE ', chr(10), 'ØSTERBY ') ELSE '' END,
    CASE WHEN doc_id % 9 < 5 THEN 'Jane@mail.example ' ELSE '' END, CASE WHEN doc_id % 10 < 5 THEN '(12 34) 56-78 ' ELSE 'x' END, chr(10),
    CASE WHEN doc_id % 11 = 0 THEN 'Experience Education SKILLS ' ELSE 'Summary ' END, CASE WHEN doc_id % 13 = 0 THEN '@GARBLE@' WHEN doc_id % 13 = 1 THEN '@LIG@' ELSE '' END,
    CASE WHEN doc_id % 17 = 0 THEN RX'\\textbf{x} \\\\ $\\alpha$' ELSE '' END, text) AS text FROM documents)"""
_CV_SPARK = _CV.replace("@GARBLE@", "Ã¸ �").replace("@LIG@", "ﬁ")
CV = duck_text(_CV_SPARK)


def cv(spark, d):
    return derive(spark, d, _CV_SPARK, "cv")


def _flat(x: str) -> str:
    return f"replace(lower(trim(regexp_replace(nfc_normalize({x}), '\\s+', ' ', 'g'))), 'ß', 'ss')"


_CONTACT = f"""contact AS (SELECT doc_id, name, email, phone, email IS NOT NULL AND NOT contains({_flat('text')}, {_flat('email')}) AS no_email,
  phone IS NOT NULL AND NOT (contains(regexp_replace(text, '\\D', '', 'g'), '4512345678') OR contains(regexp_replace(text, '\\D', '', 'g'), '12345678')) AS no_phone,
  name IS NOT NULL AND NOT contains({_flat('text')}, {_flat('name')}) AS no_name FROM cv)"""


@query("q3_check_contact", f"""WITH {CV}, {_CONTACT} SELECT doc_id, CASE WHEN name IS NULL AND email IS NULL AND phone IS NULL THEN 'warn' WHEN no_email OR no_name THEN 'fail'
  WHEN no_phone THEN 'warn' ELSE 'pass' END AS verdict, CASE WHEN name IS NULL AND email IS NULL AND phone IS NULL THEN 'no name, email or phone to check against'
  WHEN no_email OR no_name OR no_phone THEN concat('missing from the text layer: ', concat_ws(', ', CASE WHEN no_email THEN concat('email (', email, ')') END,
    CASE WHEN no_phone THEN concat('phone (', phone, ')') END, CASE WHEN no_name THEN concat('name (', name, ')') END)) ELSE 'name, email and phone all extract' END AS detail FROM contact""")
def _q3(spark, d):
    check = quality.check_contact(F.col("text"), F.col("name"), F.col("email"), F.col("phone"))
    return _check(cv(spark, d), "doc_id", check)


@query("q4_check_reading_order", f"""WITH {CV}, p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'østerby' WHEN 1 THEN 'ny' END AS s, {_flat('text')} AS t FROM cv)
SELECT doc_id, CASE WHEN s IS NULL THEN 'warn' WHEN contains(substr(t, 1, 300), s) THEN 'pass' ELSE 'fail' END AS verdict,
  CASE WHEN s IS NULL THEN 'no name to look for' WHEN contains(substr(t, 1, 300), s) THEN concat('name extracts at character ', strpos(t, s) - 1)
   ELSE concat('the name is ', CASE WHEN strpos(t, s) > 0 THEN concat('character ', strpos(t, s) - 1) ELSE 'not on page 1 at all' END, ', not in the first 300') END AS detail FROM p""")
def _q4(spark, d):
    return _check(cv(spark, d), "doc_id", quality.check_reading_order(F.col("text"), F.col("name")))


_BAD = " + ".join(f"CAST(contains(text, '{s}') AS INTEGER)" for s in ("Ã¸", "Ã¦", "Ã¥", "Ã¼", "â€", "�"))


@query("q5_check_encoding", f"""WITH {CV}, e AS (SELECT doc_id, {_BAD} AS bad, regexp_matches(text, '[\\x{{FB00}}-\\x{{FB04}}]') AS lig FROM cv)
SELECT doc_id, CASE WHEN bad > 0 THEN 'fail' WHEN lig THEN 'warn' ELSE 'pass' END AS verdict, CASE WHEN bad > 0 THEN concat(bad, ' damaged sequence(s)')
  WHEN lig THEN 'ligature code points in the text layer' ELSE 'no mojibake, no ligature code points' END AS detail FROM e""")
def _q5(spark, d):
    return _check(cv(spark, d), "doc_id", quality.check_encoding(F.col("text")))


@query("q6_check_residue", f"""WITH {CV}, f AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\\\[a-zA-Z]{{2,}}|\\\\\\\\|\\$\\\\|\\{{\\\\'))) AS m FROM cv)
SELECT doc_id, CASE WHEN len(m) = 0 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN len(m) = 0 THEN 'no LaTeX in the text layer'
  ELSE concat('LaTeX in the extracted text: ', array_to_string(m[1:6], ', ')) END AS detail FROM f""")
def _q6(spark, d):
    return _check(cv(spark, d), "doc_id", quality.check_residue(F.col("text")))


_HEADS = "list_filter(['certification', 'education', 'employment', 'experience', 'profile', 'skills', 'summary', 'work history'], lambda w: contains(lower(text), w))"


@query("q7_check_headings", f"""WITH {CV} SELECT doc_id, CASE WHEN len({_HEADS}) >= 3 THEN 'pass' ELSE 'warn' END AS verdict,
  CASE WHEN len({_HEADS}) >= 3 THEN concat('found ', array_to_string({_HEADS}, ', ')) WHEN len({_HEADS}) = 0 THEN 'only found none' ELSE concat('only found ', array_to_string({_HEADS}, ', ')) END AS detail FROM cv""")
def _q7(spark, d):
    return _check(cv(spark, d), "doc_id", quality.check_headings(F.col("text")))


# Words too common to be keywords.
_STOP = (
    "a about all an and any are as at be been both but by can for from has have how in into is it its more most not of on one or our out over role should such that the their "
    "them then there these they this to up very was we were what when where which who will with would you your job work team teams years experience working well also new other within "
    "ability across basis business clear company ensure ensuring good help including make opportunity part people position provide responsible solution solutions strong take us using want way while world"
)
_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP.split())
_KEYS = f"""kw AS (SELECT doc_id, trim(unnest(regexp_extract_all(lower(text), '[\\p{{L}}][\\p{{L}}\\p{{N}}_+#./-]{{2,}}')), './-') AS word FROM documents),
  kc AS (SELECT doc_id, word, count(*) AS n FROM kw WHERE length(word) >= 3 AND word NOT IN ({_STOP_SQL}) GROUP BY 1, 2 HAVING count(*) >= 2),
  kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM kc QUALIFY rank <= 25)"""


@query("q8_top_keywords", f"WITH {_KEYS} SELECT doc_id, rank, word, n FROM kr")
def _q8(spark, d):
    return quality.top_keywords(table(spark, d, "documents"), "doc_id", "text")


_PAIRED = f"""{_KEYS}, ka AS (SELECT doc_id, list(word ORDER BY rank) AS k FROM kr GROUP BY 1),
  pair AS (SELECT d.doc_id, lower(d.text) AS low, ka.k FROM documents d LEFT JOIN ka ON ka.doc_id = d.doc_id - 4)"""
_COVERAGE = """CASE WHEN k IS NULL THEN 'no job description given, or nothing to extract from it' ELSE
  concat(CAST(round_even(100.0 * len(list_filter(k, lambda w: contains(low, w))) / len(k), 0) AS INTEGER), '% of the posting''s ', len(k), ' commonest terms are in the PDF',
   CASE WHEN len(list_filter(k, lambda w: NOT contains(low, w))) > 0 THEN concat('. Absent: ', array_to_string(list_filter(k, lambda w: NOT contains(low, w))[1:CASE WHEN
     len(list_filter(k, lambda w: contains(low, w)))::DOUBLE / len(k) >= 0.6 THEN 8 ELSE 12 END], ', ')) ELSE '' END) END"""
_COVERED = "CASE WHEN k IS NOT NULL AND len(list_filter(k, lambda w: contains(low, w)))::DOUBLE / len(k) >= 0.6 THEN 'pass' ELSE 'warn' END"


def _paired(spark, d, docs):
    keys = quality.keyword_arrays(quality.top_keywords(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return docs.join(keys.withColumn("doc_id", F.col("doc_id") + 4), "doc_id", "left")


@query("q9_keyword_coverage", f"WITH {_PAIRED} SELECT doc_id, {_COVERED} AS verdict, {_COVERAGE} AS detail FROM pair")
def _q9(spark, d):
    rows = _paired(spark, d, table(spark, d, "documents"))
    return _check(rows, "doc_id", quality.check_keywords(F.col("text"), F.col("keywords")))


def _checks(spark, d):
    rows = cv(spark, d).withColumns({
        "chars": F.length(F.btrim("text")), "pages": F.floor(F.col("n_chars") / 3000) + 1,
    })
    # the page is named after the join, so that the text goes through it once
    return quality.run_checks(_paired(spark, d, rows).withColumn("first_page", F.col("text")), "doc_id")


def _part(place: int, name: str, sql: str) -> str:
    return f"SELECT doc_id, {place} AS place, '{name}' AS name, verdict, detail FROM ({sql})"


_CV_PAIRED = f"""{CV}, {_KEYS}, ka AS (SELECT doc_id, list(word ORDER BY rank) AS k FROM kr GROUP BY 1),
  pair AS (SELECT cv.doc_id, lower(cv.text) AS low, ka.k FROM cv LEFT JOIN ka ON ka.doc_id = cv.doc_id - 4)"""
_ALL_CHECKS = " UNION ALL ".join([
    _part(0, "text layer", f"""WITH {CV} SELECT doc_id, CASE WHEN n >= 800 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN n >= 800 THEN concat(n, ' characters extracted')
      ELSE concat('only ', n, ' characters extracted, expected at least 800') END AS detail FROM (SELECT doc_id, length(trim(text)) AS n FROM cv)"""),
    _part(1, "pages", """SELECT doc_id, CASE WHEN n <= 2 THEN 'pass' ELSE 'fail' END AS verdict,
      CASE WHEN n <= 2 THEN concat(n, ' page(s)') ELSE concat(n, ' pages, limit is 2') END AS detail FROM (SELECT doc_id, n_chars // 3000 + 1 AS n FROM documents)"""),
    *[_part(i, name, ORACLES[key]) for i, (name, key) in enumerate((
        ("contact", "q3_check_contact"), ("reading order", "q4_check_reading_order"), ("encoding", "q5_check_encoding"),
        ("residue", "q6_check_residue"), ("headings", "q7_check_headings")), start=2)],
    _part(7, "keywords", f"WITH {_CV_PAIRED} SELECT doc_id, {_COVERED} AS verdict, {_COVERAGE} AS detail FROM pair"),
])


@query("q10_run_checks", _ALL_CHECKS)
def _q10(spark, d):
    return _checks(spark, d)


@query("q10_report", f"SELECT verdict, count(*) AS n FROM ({_ALL_CHECKS}) GROUP BY verdict")
def _q10b(spark, d):
    return quality.report(_checks(spark, d))
