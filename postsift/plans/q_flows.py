"""Registered queries: flows and streams (flow_*, W*)."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from postsift.operators import dedup
from postsift.plans import flows
from postsift.plans.adapters import POSTINGS, REPLIES, TODAY, derive, postings, replies, shared_path, table
from postsift.plans.q_dedup import archive, filter_new_sql
from postsift.plans.q_hygiene import company_key, head, loose, title_key
from postsift.plans.q_rules import _ROUTE, KEYWORDS, RULES, stub_scorer
from postsift.plans.registry import ORACLES, query
from postsift.sources.feeds import complete_seen
from postsift.streaming import daily, incremental, replies as rp, runner

_RANK = "CASE site WHEN 'linkedin' THEN 0 WHEN 'indeed' THEN 1 WHEN 'careerjet' THEN 4 WHEN 'jobindex' THEN 6 ELSE 99 END"
_MERGED = f"""{POSTINGS}, lk AS (SELECT *, {loose('title')} AS lt, {loose('company')} AS lc FROM postings),
  merged AS (SELECT * EXCLUDE (lt, lc) FROM lk QUALIFY lt = '' OR row_number() OVER (PARTITION BY lt, lc ORDER BY {_RANK}, -length(description), pos) = 1)"""


@query("flow_daily_funnel", f"""WITH {_MERGED}, r AS (SELECT {_ROUTE} AS status FROM merged)
SELECT 'clean' AS guard, coalesce(status, 'to_score') AS status, count(*) AS n FROM r GROUP BY 1, 2""")
def _funnel(spark, d):
    return flows.day_funnel(postings(spark, d), KEYWORDS, RULES)


_KEYED_MERGED = f"""{_MERGED}, keyed AS (SELECT *, {company_key('company')} AS company_key, {title_key('title')} AS title_key,
  {head('description')} AS desc_head FROM merged)"""
_LEN = "(length(title) + length(description))"


@query("flow_daily_run", f"""WITH {_MERGED}, fresh AS ({filter_new_sql(_KEYED_MERGED)}), s AS (SELECT m.pos, outcome, CASE WHEN outcome = 'new' THEN
   CASE WHEN {_ROUTE} IS NOT NULL THEN {_ROUTE} WHEN {_LEN} % 13 = 0 THEN 'scoring_error' WHEN {_LEN} % 7 = 0 THEN 'rejected_language' ELSE 'new' END END AS status,
   CASE WHEN outcome = 'new' THEN CASE WHEN {_ROUTE} IS NULL AND {_LEN} % 13 <> 0 AND {_LEN} % 7 <> 0 THEN {_LEN} % 101 ELSE 0 END END AS score
   FROM merged m JOIN fresh f ON f.pos = m.pos)
SELECT pos, outcome, status, CAST(score AS INTEGER) AS score FROM s""")
def _daily(spark, d):
    outcomes, scored = flows.daily_run(
        postings(spark, d), archive(spark, d), TODAY, KEYWORDS, RULES, F.concat("title", "description"), stub_scorer, wait=0
    )
    return outcomes.select("pos", "outcome").join(scored.select("pos", "status", "score"), "pos", "left")


@query("w1_incremental_dedup", f"""WITH {_MERGED}, f AS ({filter_new_sql(_KEYED_MERGED)})
SELECT outcome, count(*) AS n FROM f GROUP BY 1""")
def _w1(spark, d):
    """One run's selection; the tests drive several runs through the stream."""
    kept = dedup.filter_new(dedup.dedup_cross_source(postings(spark, d)), complete_seen(archive(spark, d)), TODAY)
    return kept.groupBy("outcome").agg(F.count("*").alias("n"))


#: Adverts that come again, under the same address or another one, in three batches on these days.
_BATCH_DAYS = (dt.date(2024, 1, 1), dt.date(2024, 1, 5), dt.date(2024, 1, 20))
_ARRIVALS = """arrivals AS (SELECT doc_id AS pos, CAST(doc_id % 3 AS INT) AS batch, concat('https://again.example/', CAST(floor(doc_id / 4) AS INT)) AS url,
  concat('role', CAST(floor(doc_id / 6) AS INT)) AS title, concat('firm', CAST(floor(doc_id / 6) AS INT) % 7) AS company,
  CASE WHEN doc_id % 4 = 0 THEN 'scoring_error' WHEN doc_id % 9 = 0 THEN 'rejected_language' ELSE 'new' END AS status FROM documents)"""


def _batches_sql(lookback: int) -> str:
    """The history after each batch, from the one before."""
    steps = ["h0 AS (SELECT url, title, status, 0 AS attempts, DATE'2000-01-01' AS first_seen FROM arrivals WHERE false)"]
    for b, day in enumerate(_BATCH_DAYS):
        steps.append(f"""u{b} AS (SELECT * FROM (SELECT * FROM arrivals WHERE batch = {b} QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos) = 1)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1),
  s{b} AS (SELECT * FROM h{b} WHERE NOT (status = 'scoring_error' AND attempts <= 3)),
  n{b} AS (SELECT * FROM u{b} WHERE url NOT IN (SELECT url FROM s{b})
    AND title NOT IN (SELECT title FROM s{b} WHERE first_seen >= DATE'{day}' - {lookback})),
  h{b + 1} AS (SELECT coalesce(h.url, n.url) AS url, coalesce(h.title, n.title) AS title,
    CASE WHEN n.url IS NULL THEN h.status ELSE n.status END AS status,
    CASE WHEN n.url IS NULL THEN h.attempts ELSE coalesce(h.attempts, 0) + 1 END AS attempts,
    coalesce(h.first_seen, DATE'{day}') AS first_seen FROM h{b} h FULL JOIN n{b} n ON n.url = h.url)""")
    return ",\n  ".join(steps)


@query("w1_incremental_batches", f"""WITH {_ARRIVALS}, {_batches_sql(7)}
SELECT substr(sha256(url), 1, 16) AS job_id, title, status, CAST(attempts AS INTEGER) AS attempts, first_seen FROM h{len(_BATCH_DAYS)}""")
def _w1_batches(spark, d):
    """Three landed batches: the first was recorded before its stream could say so, the second fails once."""
    blank = [F.lit("").alias(c) for c in ("location", "description", "date_posted", "salary", "search_term")]
    rows = derive(spark, d, _ARRIVALS, "arrivals").select(
        "pos", "batch", "url", "title", "company", F.lit("linkedin").alias("site"), F.col("status").alias("verdict"), *blank)
    folder, root, state = (shared_path(spark, f"w1-{name}") for name in ("in", "history", "state"))
    for b in range(len(_BATCH_DAYS)):
        rows.where(F.col("batch") == b).drop("batch").coalesce(1).write.parquet(f"{folder}/{b}")
    calls = []

    def score(batch):
        calls.append(None)
        if len(calls) == 2:
            raise ConnectionError("the scorer is away")
        return batch.withColumns({"status": F.col("verdict"), "score": F.lit(1.0), "verdict_json": F.lit("")}).drop("verdict")

    first = spark.read.schema(rows.drop("batch").schema).parquet(f"{folder}/0")
    incremental.run_batch(first, root, incremental.version_of(0), _BATCH_DAYS[0], score, lookback=7)
    for _ in range(2):
        stream = runner.landed(spark, folder, rows.drop("batch").schema, nested=True, files_per_batch=1)
        try:
            incremental.incremental_dedup(stream, root, state, score, lambda n: _BATCH_DAYS[n], lookback=7)
        except StreamingQueryException as failed:
            if "the scorer is away" not in str(failed):
                raise
    return incremental.history_at(spark, root).select("job_id", "title", "status", "attempts", "first_seen")


def _sessions(quiet_minutes: int) -> str:
    q = f"INTERVAL {quiet_minutes} MINUTE"
    return f"""{REPLIES.replace('STRING', 'VARCHAR')}, m AS (SELECT update_id, chat_id, ts, trim(text) AS text, starts_with(lower(trim(text)), '/done') AS done FROM replies
    WHERE trim(text) <> '' AND (starts_with(lower(trim(text)), '/done') OR NOT starts_with(trim(text), '/'))),
  l AS (SELECT *, lag(ts) OVER w AS pt, lag(done) OVER w AS pd FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY ts, update_id)),
  f AS (SELECT *, pt IS NULL OR pd OR ts - pt >= {q} AS fresh FROM l),
  n AS (SELECT *, sum(CASE WHEN fresh AND NOT done THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY ts, update_id) AS s FROM f WHERE NOT (done AND fresh)),
  p AS (SELECT *, min(ts) OVER (PARTITION BY chat_id, s) AS start FROM n),
  g AS (SELECT chat_id, s, (epoch_us(ts) - epoch_us(start)) // 86400000000 AS piece, any_value(start) AS start, max(ts) FILTER (NOT done) AS last, min(ts) FILTER (done) AS done_at,
    count(*) FILTER (NOT done) AS answers, string_agg(text, chr(10) || chr(10) ORDER BY ts, update_id) FILTER (NOT done) AS text FROM p GROUP BY 1, 2, 3),
  o AS (SELECT *, start + to_microseconds(piece * 86400000000) AS opened FROM g WHERE answers > 0),
  sessions AS (SELECT chat_id, opened, coalesce(done_at, least(last + {q}, opened + INTERVAL 24 HOUR)) AS closed,
    CASE WHEN done_at IS NOT NULL THEN 'done' WHEN last + {q} <= opened + INTERVAL 24 HOUR THEN 'quiet' ELSE 'deadline' END AS reason, answers, text FROM o)"""


def _stamped(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz").cast("string") for c in ("opened", "closed")})


def _listed(minutes: int) -> str:
    stamp = "rtrim(rtrim(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"
    return f"""WITH {_sessions(minutes)} SELECT chat_id, {stamp.format(c='opened')} AS opened, {stamp.format(c='closed')} AS closed, reason, answers FROM sessions"""


@query("w2_reply_sessions", _listed(30))
def _w2(spark, d):
    return _stamped(rp.reply_sessions(replies(spark, d))).select("chat_id", "opened", "closed", "reason", "answers")


@query("w2_reply_sessions_long", _listed(2160))
def _w2b(spark, d):
    """A quiet time of a day and a half, so that the deadline is what closes."""
    rows = rp.reply_sessions(replies(spark, d), quiet=dt.timedelta(minutes=2160))
    return _stamped(rows).select("chat_id", "opened", "closed", "reason", "answers")


@query("w2_reply_sessions_stream", f"""WITH {_sessions(30)}, late AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM m)
SELECT chat_id, rtrim(rtrim(strftime(opened, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS opened, reason, answers, text FROM sessions, late
WHERE reason = 'done' OR closed < mark OR EXISTS (SELECT 1 FROM m WHERE m.chat_id = sessions.chat_id AND m.ts >= sessions.closed)""")
def _w2s(spark, d):
    """The exchanges that have closed by the watermark of what has landed."""
    stream = runner.landed(spark, d, table(spark, d, "events").schema, "events.parquet")
    updates = stream.select(
        F.col("event_id").alias("update_id"), F.col("user_id").cast("string").alias("chat_id"), "ts",
        F.when(F.col("event_type") == "signup", "/done").when(F.col("event_type") == "error", "/help")
        .when(F.col("event_type") == "click", "  ")
        .otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("text"),
    )
    closed = runner.run_available(rp.reply_sessions_stream(updates), "replies")
    return _stamped(closed).select("chat_id", "opened", "reason", "answers", "text")


@query("w3_answers_text", f"WITH {_sessions(360)} SELECT chat_id, answers, text FROM sessions")
def _w3(spark, d):
    return rp.reply_sessions(replies(spark, d), quiet=dt.timedelta(minutes=360)).select("chat_id", "answers", "text")


@query("w5_daily_funnel_stream", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS best FROM events GROUP BY 1")
def _w5(spark, d):
    stream = runner.landed(spark, d, table(spark, d, "events").schema, "events.parquet")
    scored = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
    return runner.run_available(daily.daily_funnel_stream(scored), "daily", "complete")


@query("w6_lookback_dedup", """WITH RECURSIVE days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
  hop AS (SELECT a.user_id, a.d, min(b.d) AS nxt FROM days a LEFT JOIN days b ON b.user_id = a.user_id AND b.d > a.d + 7 GROUP BY 1, 2),
  kept AS (SELECT user_id, min(d) AS d FROM days GROUP BY 1 UNION ALL SELECT k.user_id, h.nxt FROM kept k JOIN hop h ON h.user_id = k.user_id AND h.d = k.d WHERE h.nxt IS NOT NULL)
SELECT e.user_id AS content_key, min(e.event_id) AS pos FROM kept k JOIN events e ON e.user_id = k.user_id AND CAST(e.ts AS DATE) = k.d GROUP BY e.user_id, k.d""")
def _w6(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("content_key"), "ts")
    return daily.lookback_dedup(rows).select("content_key", "pos")


@query("w6_lookback_dedup_stream", ORACLES["w6_lookback_dedup"])
def _w6s(spark, d):
    """The same selection from files that land out of order; a last file without a key moves the watermark on."""
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("content_key"), F.col("ts").cast("timestamp").alias("ts"))
    folder = shared_path(spark, "events-in")
    # every other event is a day late
    part = F.floor((F.unix_seconds("ts") / 86400 + F.col("pos") % 2) / 6)
    parts = [r[0] for r in rows.select(part.alias("p")).distinct().orderBy("p").collect()]
    for i, p in enumerate(parts):
        # one file a batch, in row groups that several tasks can read
        rows.where(part == p).repartition(1).write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/{i:04d}")
    last = rows.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(
        F.lit(-1).cast("long").alias("pos"), F.lit(None).cast(rows.schema["content_key"].dataType).alias("content_key"),
        (F.col("ts") + F.expr("INTERVAL 40 DAYS")).alias("ts"))
    last.coalesce(1).write.parquet(f"{folder}/{len(parts):04d}")
    stream = runner.landed(spark, folder, rows.schema, files_per_batch=1, nested=True)
    kept = runner.run_available(daily.lookback_dedup_stream(stream, 7, "36 hours"), "lookback")
    return kept.select("content_key", "pos")
