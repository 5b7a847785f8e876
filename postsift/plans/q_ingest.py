"""Registered queries: scans, feed mapping, collecting (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.functions import text as tx
from postsift.plans.adapters import (
    OUTCOMES, POSTINGS, RUN_LOG, SEEN, derive, duck_text, outcomes, postings, run_log, seen,
    shared_path, table,
)
from postsift.plans.registry import query
from postsift.sources import feeds, items, markup

_STATUS = """CASE WHEN lower(status) LIKE '%offer%' THEN 'offer'
  WHEN regexp_matches(lower(status), 'reject|declined|unsuccessful') THEN 'rejected'
  WHEN regexp_matches(lower(status), 'interview|screen|technical call|video call|onsite') THEN 'interviewing'
  WHEN regexp_matches(lower(status), 'withdrawn|withdrew|skipped|not applied') THEN 'withdrawn'
  WHEN regexp_matches(lower(status), 'no response|no_response|ghosted|silence') THEN 'no_response'
  WHEN regexp_matches(lower(status), 'applied|submitted|acknowledg') THEN 'applied' ELSE 'other' END"""


@query("s1_read_seen_jobs", f"""WITH {SEEN} SELECT job_id, first_seen, status, attempts, verdict_json
FROM seen WHERE first_seen >= DATE'2024-01-23'""")
def _s1(spark, d):
    path = shared_path(spark, "seen")
    seen(spark, d).write.partitionBy("first_seen").parquet(path)
    rows = feeds.read_seen(spark, path).filter("first_seen >= DATE'2024-01-23'")
    return rows.select("job_id", "first_seen", "status", "attempts", "verdict_json")


@query("s2_read_outcomes", f"""WITH {OUTCOMES} SELECT trim(title) AS title, trim(company) AS company, status, {_STATUS} AS class
FROM outcomes WHERE trim(title) <> '' OR trim(company) <> ''""")
def _s2(spark, d):
    messy = outcomes(spark, d).select(
        F.concat(F.lit(" "), "title").alias("﻿Title "), F.col("company").alias("COMPANY"),
        F.concat("status", F.lit("  ")).alias(" Status"), F.col("doc_id").alias("extra"),
    )
    return feeds.clean_outcomes(messy)


@query("s2_read_outcomes_csv", f"""WITH {OUTCOMES} SELECT trim(title) AS title, trim(company) AS company, status, {_STATUS} AS class
FROM outcomes WHERE trim(title) <> '' OR trim(company) <> ''""")
def _s2_csv(spark, d):
    """The same from CSV files with a byte order mark, another order of columns and quoted cells."""
    path = shared_path(spark, "outcomes")
    outcomes(spark, d).select(
        F.col("company").alias("﻿COMPANY"), F.col("doc_id").alias("extra"), F.concat("status", F.lit("  ")).alias(" Status"),
        F.concat(F.lit(" "), "title", F.lit(" ")).alias("Title "),
    ).write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    return feeds.read_outcomes(spark, path, multi_line=True)


_SAFE = "trim(regexp_replace(regexp_replace(text, RX'[^A-Za-z ]', ''{g}), RX' +', ' '{g}))"
_ITEMS = """items AS (SELECT doc_id, concat('{"',
    CASE doc_id % 3 WHEN 0 THEN 'positionName' WHEN 1 THEN 'title' ELSE 'jobTitle' END, '": "  ', safe, ' ", ',
    CASE doc_id % 4 WHEN 0 THEN concat('"company": {"name": "', source, '"}')
      WHEN 1 THEN concat('"company": "", "companyName": "', source, '"')
      WHEN 2 THEN concat('"company": {"id": 3, "title": {"text": "', source, '"}}')
      ELSE concat('"employer": ["', source, '", "", "', lang, '"]') END,
    ', "location": "', CASE WHEN doc_id % 5 = 0 THEN 'Remote, Denmark' ELSE lang END, '"',
    ', "link": "https://', source, '.example/', CAST(doc_id AS STRING), '"',
    ', "publishedAt": "', CASE WHEN doc_id % 6 = 0 THEN 'Today' ELSE '2026-08-20T09:00:00.000Z' END, '"',
    ', "salary": ', CAST(doc_id AS STRING),
    ', "jobType": ', CASE WHEN doc_id % 2 = 0 THEN '["a", "b"]' ELSE '[], "contractType": "fixed"' END,
    ', "isRemote": ', CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '"hybrid"' END,
    ', "snippet": "<p>', safe, '</p>  <b>', lang, '</b>"}') AS raw,
    safe, source, lang FROM (SELECT *, @SAFE@ AS safe FROM documents))"""
_ITEMS_SPARK = _ITEMS.replace("@SAFE@", _SAFE.replace("{g}", ""))
ITEMS = duck_text(_ITEMS.replace("@SAFE@", _SAFE.replace("{g}", ", 'g'")))


@query("s3_map_alias", f"""WITH {ITEMS} SELECT doc_id, safe AS title,
  CASE WHEN doc_id % 4 = 3 THEN concat(source, ', ', lang) ELSE source END AS company,
  CASE WHEN doc_id % 5 = 0 THEN 'Remote, Denmark' ELSE lang END AS location,
  trim(regexp_replace(concat(safe, ' ', lang), ' +', ' ', 'g')) AS description,
  concat('https://', source, '.example/', doc_id) AS url,
  CASE WHEN doc_id % 6 = 0 THEN 'Today' ELSE '2026-08-20' END AS date_posted,
  CAST(doc_id AS VARCHAR) AS salary, CASE WHEN doc_id % 2 = 0 THEN 'a, b' ELSE 'fixed' END AS job_type,
  CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE doc_id % 5 = 0 END AS is_remote,
  'apify' AS site, 'term' AS search_term FROM items""")
def _s3(spark, d):
    raw = derive(spark, d, _ITEMS_SPARK, "items").select("doc_id", "raw")
    return items.map_alias(raw, "apify", F.lit("term"))


@query("s4_as_text", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'yes' WHEN 2 THEN CAST(event_id AS VARCHAR)
  WHEN 3 THEN concat(event_type, ', ', CAST(user_id AS VARCHAR)) ELSE event_type END AS shown FROM events""")
def _s4(spark, d):
    k, kind = F.col("event_id") % 5, F.col("event_type")
    raw = table(spark, d, "events").select(
        "event_id",
        F.when(k == 0, '" click "').when(k == 1, "true").when(k == 2, F.col("event_id").cast("string"))
        .when(k == 3, F.concat(
            F.lit('["'), kind, F.lit('", "", [[], {"name": {"title": {"text": {"value": ["'), F.col("user_id").cast("string"), F.lit('"]}}}}]]')))
        .otherwise(F.concat(F.lit('{"name": "", "displayName": "'), kind, F.lit('"}'))).alias("raw"),
    )
    return raw.select("event_id", items.as_text(F.try_parse_json("raw")).alias("shown"))


@query("s5_iso_date_prefix", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Today' WHEN event_id % 4 = 1 THEN ''
  ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events""")
def _s5(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, "Today").when(F.col("event_id") % 4 == 1, F.lit(None)).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    return table(spark, d, "events").select("event_id", tx.iso_date_prefix(raw).alias("day"))


@query("s6_rfc2822_date", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'yesterday'
  ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events""")
def _s6(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("yesterday")).otherwise(
        F.concat(F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    )
    return table(spark, d, "events").select("event_id", tx.rfc2822_date(raw).alias("day"))


@query("s7_format_salary", """SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN 'as agreed' WHEN o_orderkey % 5 = 1 THEN ''
    WHEN o_orderkey % 5 = 2 THEN concat('EUR ', format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)), '+/yr')
    ELSE concat('EUR ', format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)), '-',
      format('{:,}', CAST(trunc(o_totalprice + 1000) AS BIGINT)), '/yr') END AS salary,
  CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE concat('DKK ', format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)), '+ / yearly') END AS other_layout
FROM orders""")
def _s7(spark, d):
    k = F.col("o_orderkey") % 5
    low = F.when(k == 1, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    high = F.when(k > 2, F.col("o_totalprice") + 1000)
    return table(spark, d, "orders").select(
        "o_orderkey",
        tx.format_salary(low, high, F.lit("EUR"), tx.pay_suffix(F.lit("Y")), F.when(k == 0, " as agreed")).alias("salary"),
        tx.format_salary(low, F.lit(None), F.lit("DKK"), tx.slash_suffix(F.lit("yearly")), F.lit("")).alias("other_layout"),
    )


@query("s8_detect_remote", f"""WITH {POSTINGS} SELECT pos, CASE WHEN pos % 3 = 0 THEN is_remote
  ELSE pos % 4 < 2 END AS remote FROM postings""")
def _s8(spark, d):
    flag = F.when(F.col("pos") % 3 == 0, F.col("is_remote"))
    shown = F.when(F.col("pos") % 4 == 0, F.concat("location", F.lit(" REMOTE"))).when(
        F.col("pos") % 4 == 1, F.lit("Hjemmearbejde muligt")
    ).otherwise(F.col("location"))
    return postings(spark, d).select("pos", tx.detect_remote(flag, shown).alias("remote"))


@query("s9_map_feed", """SELECT page_id AS pos, url, concat('R&D "', page_id, '" <x>') AS title,
  CASE WHEN page_id % 2 = 0 THEN 'A & B' ELSE 'C''s' END AS company, 'Aarhus' AS location,
  CASE WHEN page_id % 3 = 0 THEN 'fuldtid, deltid' ELSE '' END AS job_type, 'jobdanmark' AS site FROM pages""")
def _s9(spark, d):
    raw = table(spark, d, "pages").select(
        F.col("page_id").alias("pos"), "url",
        F.concat(F.lit("R&amp;D &quot;"), F.col("page_id").cast("string"), F.lit("&#34; &lt;x&gt;")).alias("title"),
        F.when(F.col("page_id") % 2 == 0, "A &amp; B").otherwise("").alias("company"),
        F.lit("C&#39;s").alias("companyName"),
        F.lit("Aarhus").alias("location"),
        F.when(F.col("page_id") % 3 == 0, F.array(F.lit("fuldtid"), F.lit("deltid"))).alias("jobTypes"),
        F.lit("2024-01-30").alias("date"),
    )
    mapped = feeds.map_feed(raw, feeds.FEED_MAPS["jobdanmark"], F.lit("term"))
    return mapped.select("pos", "url", "title", "company", "location", "job_type", "site")


@query("s9_map_board", """SELECT o_orderkey AS pos, concat('Role ', o_orderkey) AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Firm' END AS company,
  concat('https://b.example/', o_orderkey) AS url, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_posted,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('EUR ', format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)), '+ / yearly')
    ELSE concat('EUR ', format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)), '-', format('{:,}', CAST(trunc(o_totalprice) AS BIGINT) + 500), ' / yearly') END AS salary,
  o_orderkey % 5 = 0 AS is_remote FROM orders WHERE o_orderkey % 7 <> 0""")
def _s9b(spark, d):
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("long")
    low = F.when(key % 4 != 0, price).cast("string")
    raw = table(spark, d, "orders").select(
        key.alias("pos"), F.concat(F.lit(" Role "), key.cast("string")).alias("title"),
        F.when(key % 3 != 0, "Firm ").alias("company"), F.lit(None).cast("string").alias("location"),
        F.lit("").alias("description"), F.lit("indeed").alias("site"), F.col("o_orderdate").cast("date").alias("date_posted"),
        F.lit("fulltime").alias("job_type"), low.alias("min_amount"),
        F.when(key % 4 > 1, price + 500).alias("max_amount"), F.lit("EUR").alias("currency"),
        F.lit("yearly").alias("interval"), F.when(key % 5 == 0, True).alias("is_remote"),
        F.when(key % 7 == 0, "  ").otherwise(F.concat(F.lit("https://b.example/"), key.cast("string"))).alias("job_url"),
    )
    return feeds.map_board(raw, F.lit("term")).select(
        "pos", "title", "company", "url", "date_posted", "salary", "is_remote")


@query("s9_map_paged", """SELECT event_id AS pos, concat('Role ', event_id) AS title, CAST(CAST(ts AS DATE) AS VARCHAR) AS date_posted,
  CASE WHEN event_id % 3 = 0 THEN 'as agreed' ELSE concat('DKK ', format('{:,}', event_id + 1000), '+/yr') END AS salary,
  event_id % 4 = 0 AS is_remote, 'careerjet' AS site FROM events""")
def _s9c(spark, d):
    key = F.col("event_id")
    raw = table(spark, d, "events").select(
        key.alias("pos"), F.concat(F.lit(" Role "), key.cast("string")).alias("title"), F.lit("Firm").alias("company"),
        F.when(key % 4 == 0, "Anywhere (Remote)").otherwise("Odense").alias("locations"), F.lit("text").alias("description"),
        F.lit("https://p.example/").alias("url"),
        F.concat(F.date_format("ts", "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("date"),
        (key + 1000).cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"),
        F.lit("DKK").alias("salary_currency_code"), F.lit("Y").alias("salary_type"),
        F.when(key % 3 == 0, "as agreed").alias("salary"),
    )
    return feeds.map_paged(raw, F.lit("term")).select("pos", "title", "date_posted", "salary", "is_remote", "site")


def _lines(x: str) -> str:
    entities = x
    for name, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&"), ("&amp", "&")):
        entities = f"replace({entities}, '{name}', '{char}')"
    return (
        "array_to_string(list_filter(list_transform(string_split(" + entities + ", chr(10)), "
        "lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
    )


_BROKEN = "regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>|</p>|</li>|</h\\d>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"


@query("s10_html_to_text", f"SELECT page_id, {_lines(_BROKEN.format(x='html'))} AS body FROM pages")
def _s10(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("body"))


_VISIBLE = (
    "regexp_replace({x}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g')"
)


@query("s11_page_text", f"SELECT page_id, {_lines(_BROKEN.format(x=_VISIBLE.format(x='html')))} AS body FROM pages")
def _s11(spark, d):
    return table(spark, d, "pages").select("page_id", tx.page_text(F.col("html")).alias("body"))


@query("s12_strip_tags_inline", """SELECT page_id,
  trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages""")
def _s12(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_tags_inline(F.col("html")).alias("body"))


@query("s13_extract_ld_posting", """SELECT conv_id, turn,
  CASE turn % 3 WHEN 2 THEN NULL ELSE concat('Role ', CAST(conv_id AS VARCHAR)) END AS title,
  CASE turn % 3 WHEN 2 THEN NULL ELSE replace(translate(text, '"', ''), chr(10), ' ') END AS description
FROM conversations""")
def _s13(spark, d):
    posting = F.concat(
        F.lit('{"@type": "JobPosting", "title": "Role '), F.col("conv_id").cast("string"),
        F.lit('", "description": "'), F.translate("text", '"', ""), F.lit('"}'),
    )
    block = F.when(F.col("turn") % 3 == 0, posting).when(
        F.col("turn") % 3 == 1,
        F.concat(F.lit('{"@graph": [{"@type": "Person"}, [[[{"@graph": {"@graph": [[{"@graph": ['), posting, F.lit("]}]]}}]]]]}")),
    ).otherwise(F.lit('{"@type": "Person"}'))
    pages = table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.concat(
            F.lit("<html><script type='application/ld+json'>{broken</script><SCRIPT type=\"application/ld+json\">"),
            block, F.lit("</SCRIPT></html>"),
        ).alias("html"),
    )
    found = markup.extract_ld_posting(pages)
    return found.select("conv_id", "turn", F.col("ld_title").alias("title"), F.col("ld_description").alias("description"))


_CARD = "trim(regexp_replace(regexp_replace(regexp_extract(html, RX'(?s)<h1>(.*?)</h1>', 1), RX'[^A-Za-z ]', ''{g}), RX' +', ' '{g}))"
_CARDS = "cards AS (SELECT page_id, concat('job ', @CARD@) AS shown FROM pages)"


@query("s14_parse_cards", "WITH " + duck_text(_CARDS.replace("@CARD@", _CARD.replace("{g}", ", 'g'"))) + """
SELECT page_id, CAST(c AS BIGINT) AS card, concat(shown, ' ', c) AS title,
  CASE WHEN c = 0 THEN concat('https://www.jobindex.dk/vis/', page_id) ELSE concat('https://ext.example/', page_id) END AS url,
  CASE WHEN c = 0 THEN 'Logo A/S' ELSE 'Employer' END AS company, 'Odense C' AS location,
  concat('First ', page_id, ' Second') AS description
FROM cards CROSS JOIN (SELECT unnest([0, 1]) AS c)""")
def _s14(spark, d):
    base = derive(spark, d, _CARDS.replace("@CARD@", _CARD.replace("{g}", "")), "cards")
    pid = F.col("page_id").cast("string")

    def card(number: int, head, foot):
        return F.concat(
            F.lit("<div class='card'><div>"), head, F.lit("<h4><a href='/fallback'>"), F.col("shown"),
            F.lit(f" {number}</a></h4><span>Odense C</span><p>First "), pid, F.lit("</p><p>Second</p><p>Third</p>"),
            F.lit("<ul><li><a href='/bruger/dine-job/x/gem'>Gem</a>"), foot, F.lit("</li></ul></div></div>"),
        )

    html = F.concat(
        F.lit("<html><body>"),
        card(0, F.lit("<img src='l.png' alt='Logo A/S'>"),
             F.concat(F.lit("<a href='/vis/"), pid, F.lit("'>Se jobbet</a>"))),
        card(1, F.lit("<a href='https://employer.example'>Employer</a>"),
             F.concat(F.lit("<a href='https://ext.example/"), pid, F.lit("'>se  <b></b>jobbet</a><a href='https://ext.example/"),
                      pid, F.lit("'>Se jobbet</a>"))),
        F.lit("</body></html>"),
    )
    return markup.parse_cards(base.withColumn("html", html), "page_id")


@query("s15_cut_after", """SELECT doc_id, trim(CASE WHEN strpos(text, ' the ') > 0
  THEN substr(text, 1, strpos(text, ' the ') - 1) ELSE text END, chr(32)) AS body FROM documents""")
def _s15(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.cut_after(F.col("text"), " the ").alias("body"))


_SEARCHES = [("platform engineer", 40), ("data architect", 25), ("analyst", 60)]
_SHARED = """rows AS (SELECT doc_id AS pos, concat('https://x.example/', CAST((doc_id * 7) % 97 AS STRING)) AS url,
  CASE doc_id % 3 WHEN 0 THEN 'platform engineer' WHEN 1 THEN 'data architect' ELSE 'analyst' END AS search_term
  FROM documents)"""


def _pick(name: str, term: str, want: int, earlier: list[str]) -> str:
    free = "".join(f" AND url NOT IN (SELECT url FROM {e})" for e in earlier)
    return (
        f"{name} AS (SELECT min(pos) AS pos, url, '{term}' AS search_term FROM rows "
        f"WHERE search_term = '{term}'{free} GROUP BY url ORDER BY min(pos) LIMIT {want})"
    )


@query("s16_cap_per_search", "WITH " + _SHARED.replace("STRING", "VARCHAR") + ", " + ", ".join([
    _pick("t0", "platform engineer", 40, []), _pick("t1", "data architect", 25, ["t0"]),
    _pick("t2", "analyst", 60, ["t0", "t1"])]) + " SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2")
def _s16(spark, d):
    return feeds.cap_per_search(derive(spark, d, _SHARED, "rows"), _SEARCHES)


@query("s16_cap_before_url", "WITH " + _SHARED.replace("STRING", "VARCHAR") + """, capped AS (
  (SELECT *, 0 AS t FROM rows WHERE search_term = 'platform engineer' ORDER BY pos LIMIT 40) UNION ALL
  (SELECT *, 1 FROM rows WHERE search_term = 'data architect' ORDER BY pos LIMIT 25) UNION ALL
  (SELECT *, 2 FROM rows WHERE search_term = 'analyst' ORDER BY pos LIMIT 60))
SELECT pos, url, search_term FROM capped QUALIFY row_number() OVER (PARTITION BY url ORDER BY t, pos) = 1""")
def _s16b(spark, d):
    return feeds.cap_per_search(derive(spark, d, _SHARED, "rows"), _SEARCHES, claim_first=False)


_FEED_ROWS = """a AS (SELECT doc_id AS pos, concat(' https://x.example/', CAST(doc_id % 700 AS STRING), ' ') AS url FROM documents),
  b AS (SELECT item_id AS pos, concat('https://x.example/', CAST(item_id * 5 AS STRING)) AS url FROM benchmark),
  c AS (SELECT page_id AS pos, CASE WHEN page_id % 6 = 0 THEN '' ELSE url END AS url FROM pages)"""


def _feeds(spark, d):
    def broken():
        raise RuntimeError("HTTP 429 Too Many Requests")

    return feeds.union_feeds(spark, [
        ("first", derive(spark, d, _FEED_ROWS, "b")),
        ("second", lambda: derive(spark, d, _FEED_ROWS, "a")),
        ("broken", broken),
        ("third", derive(spark, d, _FEED_ROWS, "c")),
    ])


_UNION = "WITH " + _FEED_ROWS.replace("STRING", "VARCHAR") + """, u AS (SELECT 'first' AS feed, 0 AS o, pos, trim(url) AS url FROM b
  UNION ALL SELECT 'second', 1, pos, trim(url) FROM a UNION ALL SELECT 'third', 3, pos, trim(url) FROM c),
  kept AS (SELECT * FROM u WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY o, pos) = 1) """


@query("s17_union_feeds", _UNION + "SELECT feed, pos, url FROM kept")
def _s17(spark, d):
    return _feeds(spark, d).rows.select("feed", "pos", "url")


@query("s17_feed_report", _UNION + """SELECT source, CASE WHEN source = 'broken' THEN 'HTTP 429 Too Many Requests' END AS error,
  CASE WHEN source <> 'broken' THEN count(feed) END AS n
FROM (SELECT unnest(['first', 'second', 'broken', 'third']) AS source) LEFT JOIN kept ON feed = source GROUP BY source""")
def _s17b(spark, d):
    return _feeds(spark, d).per_source.select("source", "error", "n")


_STUBS = f"""{POSTINGS}, rows AS (SELECT pos, site AS feed, url, title, company, concat('id', CAST(pos % 400 AS VARCHAR)) AS id,
   CASE WHEN pos % 2 = 0 THEN 'short text' ELSE description END AS description FROM postings),
 known AS (SELECT url FROM postings WHERE date_posted = '2024-01-05'),
 need AS (SELECT * FROM rows WHERE length(description) < 200 AND url NOT IN (SELECT url FROM known)),
 ids AS (SELECT feed, id, min(pos) AS p FROM need GROUP BY 1, 2
   QUALIFY row_number() OVER (PARTITION BY feed ORDER BY min(pos)) <= 60),
 got AS (SELECT n.feed, n.pos, CASE WHEN substr(n.id, 3)::INT % 7 = 0 THEN '' ELSE concat('detail of ', n.id) END AS detail
   FROM need n JOIN ids USING (feed, id))"""


@query("s18_enrich_stub", f"""WITH {_STUBS} SELECT r.pos, coalesce(nullif(g.detail, ''), r.description) AS description
FROM rows r LEFT JOIN got g USING (feed, pos)""")
def _s18(spark, d):
    posts = postings(spark, d)
    rows = posts.select(
        "pos", F.col("site").alias("feed"), "url", "title", "company",
        F.concat(F.lit("id"), (F.col("pos") % 400).cast("string")).alias("id"),
        F.when(F.col("pos") % 2 == 0, "short text").otherwise(F.col("description")).alias("description"),
    )
    known = posts.filter("date_posted = '2024-01-05'").select(tx.job_id(F.col("url")).alias("job_id"))
    details = rows.select("feed", "id").distinct().withColumn(
        "detail",
        F.when(F.substring("id", 3, 9).cast("int") % 7 == 0, "").otherwise(F.concat(F.lit("detail of "), "id")),
    )
    no_keys = posts.select(F.lit("").alias("content_key")).filter("content_key != ''")
    return feeds.enrich_stub(rows, details, known, no_keys).select("pos", "description")


@query("s19_site_label", f"""WITH {RUN_LOG}, named AS (SELECT run_id, n, CASE source WHEN 'view' THEN 'jobindex_cli' ELSE source END AS source
  FROM run_log) SELECT run_id, source, CASE source WHEN 'jobindex_cli' THEN 'jobindex' ELSE source END AS label FROM named""")
def _s19(spark, d):
    named = run_log(spark, d).withColumn(
        "source", F.when(F.col("source") == "view", "jobindex_cli").otherwise(F.col("source"))
    )
    return feeds.site_label(named).select("run_id", "source", "label")


@query("s20_unknown_sites", """SELECT DISTINCT lower(trim(s)) AS site FROM (
  SELECT unnest(CASE WHEN doc_id % 4 = 0 THEN ['linkedin', 'indeed'] ELSE [concat(' ', upper(source)), 'LinkedIn'] END) AS s
  FROM documents) WHERE lower(trim(s)) NOT IN ('linkedin', 'indeed', 'src1', 'src2')""")
def _s20(spark, d):
    searches = table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 4 != 0, F.array(F.concat(F.lit(" "), F.upper("source")), F.lit("LinkedIn"))).alias("sites")
    )
    return feeds.unknown_sites(searches, ["linkedin", "indeed", "src1", "src2"])


@query("s21_render_template", """SELECT doc_id, concat('find {', source, '} in ', lang, ' {unknown}') AS query,
  n_chars AS results FROM documents""")
def _s21(spark, d):
    values = {"term": F.concat(F.lit("{"), "source", F.lit("}")), "source": F.lit("never"),
              "lang": F.col("lang"), "results_wanted": F.col("n_chars")}
    filled = items.render_template(
        {"query": "find {term} in {lang} {unknown}", "paging": {"results": " {results_wanted} "}}, values
    )
    return table(spark, d, "documents").select("doc_id", filled.alias("t")).select(
        "doc_id", "t.query", F.col("t.paging.results").alias("results")
    )
