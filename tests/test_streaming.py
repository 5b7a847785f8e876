import datetime as dt
import random

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from postsift.sources import sinks
from postsift.streaming import daily, incremental, replies, runner

POST = ("pos bigint, title string, company string, location string, description string, url string, site string, "
        "date_posted string, salary string, search_term string")


def land(spark, folder, name, rows):
    full = [(p, t, c, "", "", u, "linkedin", "", "", "") for p, t, c, u in rows]
    spark.createDataFrame(full, POST).coalesce(1).write.parquet(f"{folder}/{name}")


def test_runs_over_landed_files(spark, tmp_path):
    inbox, root, state = str(tmp_path / "in"), str(tmp_path / "hist"), str(tmp_path / "state")
    run = lambda: incremental.incremental_dedup(
        spark.readStream.schema(POST).option("recursiveFileLookup", "true").parquet(inbox), root, state,
        incremental.unscored, lambda n: dt.date(2026, 1, 1) + dt.timedelta(n),
    )
    land(spark, inbox, "one", [(1, "Cloud Lead", "Contoso", "https://x.example/1"), (2, "Cloud Lead", "Contoso A/S", "https://x.example/2"), (3, "Chef", "Alder", "https://x.example/3")])
    run()
    assert sorted(r.url[-1] for r in incremental.history_at(spark, root).collect()) == ["1", "3"]
    run()  # nothing new has landed
    assert incremental.history_at(spark, root).count() == 2
    land(spark, inbox, "two", [(4, "Chef", "Alder Group", "https://x.example/4"), (5, "Baker", "Alder", "https://x.example/5")])
    run()
    rows = {r.url[-1]: r.first_seen for r in incremental.history_at(spark, root).collect()}
    assert rows == {"1": dt.date(2026, 1, 1), "3": dt.date(2026, 1, 1), "5": dt.date(2026, 1, 2)}
    before = sinks.current_version(spark, root)
    batch = spark.read.schema(POST).parquet(f"{inbox}/two")
    assert incremental.run_batch(batch, root, before.rsplit("/", 1)[1], dt.date(2026, 1, 9), incremental.unscored) is None


def at(minutes):
    return dt.datetime(2026, 1, 1, 8, 0) + dt.timedelta(minutes=minutes)


UPDATES = [
    (1, "me", at(0), "first"), (2, "me", at(10), " /help "), (3, "me", at(20), "second"), (3, "me", at(20), "second"),
    (4, "you", at(5), "hello"), (5, "me", at(21), "/DONE thanks"), (6, "me", at(22), "/done"), (7, "me", at(25), "third"), (8, "me", at(56), "fourth"), (9, "me", at(3000), "end"), (10, "you", at(3001), "end"),
]
SCHEMA = "update_id bigint, chat_id string, ts timestamp, text string"
WANT = {("me", "first\n\nsecond", "done"), ("you", "hello", "quiet"), ("me", "third", "quiet"), ("me", "fourth", "quiet")}


def test_reply_sessions_batch_and_stream(spark, tmp_path):
    frame = spark.createDataFrame(UPDATES, SCHEMA)
    batch = {(r.chat_id, r.text, r.reason) for r in replies.reply_sessions(frame.repartition(3)).collect()}
    assert batch == WANT | {("me", "end", "quiet"), ("you", "end", "quiet")}
    assert replies.reply_sessions(frame, after=8).count() == 2
    # One file per part of the talk: the open exchange lives in the state.
    for part, low, high in (("a", 0, 2), ("b", 3, 7), ("c", 8, 10)):
        frame.filter(F.col("update_id").between(low, high)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.chat_id, r.text, r.reason) for r in runner.run_available(replies.reply_sessions_stream(stream, "2 hours"), "t").collect()}
    assert got == WANT


def test_deadline_cuts_an_exchange_that_never_rests(spark):
    rows = [(i, "c", at(20 * i), f"m{i}") for i in range(80)]
    got = replies.reply_sessions(spark.createDataFrame(rows, SCHEMA)).orderBy("opened").collect()
    assert [(r.answers, r.reason) for r in got] == [(72, "deadline"), (8, "quiet")]


def test_lookback_memory(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    rows = [(1, "k", day(0)), (2, "k", day(0)), (3, "k", day(7)), (4, "k", day(8)), (5, "k", day(15)), (6, "k", day(16)), (7, "j", day(3))]
    frame = spark.createDataFrame(rows, "pos bigint, content_key string, ts timestamp")
    assert sorted(r.pos for r in daily.lookback_dedup(frame).collect()) == [1, 4, 6, 7]
    frame.filter("pos <= 3").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert runner.run_available(daily.lookback_dedup_stream(stream), "t").count() == 1


def streamed(spark, folder, parts, make, name):
    """Run a stream over ``parts``, one file and so one batch each; they land in order."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/{i}")
    stream = runner.landed(spark, str(folder), parts[0].schema, files_per_batch=1, nested=True)
    return runner.run_available(make(stream), name).collect()


def test_exchanges_of_a_busy_chat_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, clock = [], 0
    for i in range(600):
        clock += rng.choice([0, 1, 2, 3, 9, 29, 30, 31, 400]) if i % 7 == 0 else rng.choice([0, 0, 1, 2])
        rows.append((i, rng.choice(["busy", "busy", "quiet"]), at(clock), "/done" if rng.random() < 0.04 else f"m{i}"))
    # a day of talk that never rests, so that deadlines fall inside stretches
    rows += [(1000 + i, "long", at(clock + i * 7), f"n{i}") for i in range(450)]
    end = [(9000 + i, c, at(clock + 20_000), "end") for i, c in enumerate(["busy", "quiet", "long"])]
    frame = spark.createDataFrame(rows + end, SCHEMA)
    want = {(r.chat_id, r.opened, r.closed, r.reason, r.answers, r.text) for r in replies.reply_sessions(frame).collect() if r.text != "end"}
    parts = [spark.createDataFrame(rows[i: i + 210], SCHEMA) for i in range(0, len(rows), 210)] + [spark.createDataFrame(end, SCHEMA)]
    got = streamed(spark, tmp_path / "in", parts, replies.reply_sessions_stream, "busy")
    assert sorted((r.chat_id, r.opened, r.closed, r.reason, r.answers, r.text) for r in got) == sorted(want)
    assert sum(r.reason == "deadline" for r in got) >= 2


def test_late_and_repeated_messages_of_an_exchange(spark, tmp_path):
    parts = [
        [(1, "c", at(0), "a"), (3, "c", at(8), "c"), (7, "d", at(0), "x")],
        [(2, "c", at(4), "b"), (4, "c", at(9), "/done"), (7, "d", at(0), "x")],      # late, in order when it comes out
        [(1, "c", at(0), "a"), (3, "c", at(8), "c"), (8, "d", at(5), "y")],            # again: it has come out
        [(9, "c", at(500), "z"), (10, "d", at(500), "z")],
    ]
    got = streamed(spark, tmp_path / "in", [spark.createDataFrame(p, SCHEMA) for p in parts], replies.reply_sessions_stream, "late")
    assert {(r.chat_id, r.text, r.reason) for r in got} == {("c", "a\n\nb\n\nc", "done"), ("d", "x\n\ny", "quiet")}


def test_memory_stream_decides_days_in_order(spark, tmp_path):
    schema = "pos bigint, content_key string, ts timestamp, note string"
    day = lambda n, h=0: dt.datetime(2026, 1, 1, h) + dt.timedelta(days=n)
    parts = [
        [(1, "k", day(1, 9), "n1"), (2, "k", day(1, 9), "n2"), (3, "j", day(2), None)],
        [(4, "k", day(0, 23), "late"), (5, "k", day(9), "n5")],                        # a day late: it is the first
        [(6, "k", day(8, 20), "late too"), (7, "j", day(9), None), (8, "j", day(10), "n8")],
        [(9, "k", day(60), "n9"), (10, None, day(90), "mark")],
        [(11, "k", day(61), "n11"), (12, None, day(99), "mark")],                       # too late by far
    ]
    frames = [spark.createDataFrame(p, schema) for p in parts]
    got = streamed(spark, tmp_path / "in", frames, lambda s: daily.lookback_dedup_stream(s, 7, "2 days"), "memory")
    assert sorted(map(tuple, got)) == sorted([parts[1][0], parts[2][0], parts[0][2], parts[2][2], parts[3][0]])
    early = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3]).where("content_key IS NOT NULL")
    assert sorted(r.pos for r in daily.lookback_dedup(early).collect()) == sorted(r.pos for r in got)


def test_memory_asks_the_store_once_for_a_group_of_keys():
    """Each call to the state is a message: as many for a group, however many keys and days it has."""
    class Store:
        calls, value = 0, None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.update(None)

        def registerTimer(self, at):
            self.calls += 1

        deleteTimer = registerTimer

    class Clock:
        mark = 0

        def getCurrentWatermarkInMs(self):
            return self.mark

    store, clock = Store(), Clock()
    memory = daily.SlidingMemory(7)
    memory.init(store)
    rows = [Row(content_key=f"k{k}", day=d, at=d, pos=k, payload=f"{k}/{d}") for k in range(100) for d in (1, 2, 8, 9, 17)]
    assert list(memory.handleInputRows((0,), iter(rows), clock)) == []
    assert store.calls <= 4
    clock.mark = 18 * 86_400_000
    got = {(r.content_key, r.day, r.payload) for r in memory.handleExpiredTimer((0,), clock, None)}
    assert got == {(f"k{k}", d, f"{k}/{d}") for k in range(100) for d in (1, 9, 17)}
    assert store.calls <= 8
    clock.mark = 25 * 86_400_000
    assert list(memory.handleExpiredTimer((0,), clock, None)) == [] and store.value is None


def test_exchanges_ask_the_store_once_for_a_group_of_chats():
    """Each call to the state is a message: as many for a group, however many chats it has."""
    class Store:
        calls, value = 0, None

        def getValueState(self, name, schema):
            return self

        def getMapState(self, name, key, value):
            return self

        def getListState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def exists(self):
            return self.get() is not None

        def update(self, value):
            self.calls += 1
            self.value = value

        put = update

        def clear(self):
            self.update(None)

        def registerTimer(self, at):
            self.calls += 1

        deleteTimer = registerTimer

    class Clock:
        mark = 0

        def getCurrentWatermarkInMs(self):
            return self.mark

    store, clock, minute = Store(), Clock(), 60_000_000
    exchanges = replies.Exchanges(replies.QUIET, replies.DEADLINE)
    exchanges.init(store)
    said = lambda k, m: f'[{{"at":{m * minute},"id":{k},"text":"t{k}/{m}"}}]'
    rows = [dict(chat_id=f"c{k}", first=m * minute, id=k, last=m * minute, last_id=k, done=False, n=1, said=said(k, m))
            for k in range(100) for m in (1, 5, 90)]
    got = [(r.chat_id, r.closed, r.answers, r.pieces) for f in exchanges.handleInputRows((0,), iter([pd.DataFrame(rows)]), clock) for r in f.itertuples()]
    assert sorted(got) == sorted((f"c{k}", 35 * minute, 2, [said(k, 1), said(k, 5)]) for k in range(100))
    assert store.calls <= 4
    clock.mark = 120 * minute // 1000
    got = [(r.chat_id, r.closed, r.pieces) for f in exchanges.handleExpiredTimer((0,), clock, None) for r in f.itertuples()]
    assert sorted(got) == sorted((f"c{k}", 120 * minute, [said(k, 90)]) for k in range(100))
    assert store.calls <= 8 and store.value is None


def test_long_exchanges_of_a_group_are_kept_apart(spark, tmp_path):
    """All chats in one group: answers too long for its value come out with the rest, in order, for a chat without a name too."""
    long = {i: f"{i}" * 40_000 for i in range(1, 8)}
    parts = [
        [(1, "a", at(0), long[1]), (2, None, at(1), long[2]), (3, "null", at(2), "x")],
        [(4, "a", at(10), long[3]), (5, None, at(11), "y"), (6, "null", at(12), "/done")],
        [(7, "a", at(20), long[4]), (8, None, at(21), long[5]), (9, "a", at(22), "/done"), (10, "a", at(23), long[6])],
        [(11, "a", at(30), long[7]), (12, None, at(30), "z")],
        [(13, "b", at(900), "end")],
    ]
    make = lambda stream: replies.reply_sessions_stream(stream, "1 hour", groups=1)
    got = streamed(spark, tmp_path / "in", [spark.createDataFrame(p, SCHEMA) for p in parts], make, "apart")
    assert {(r.chat_id, r.text, r.reason) for r in got} == {
        ("a", "\n\n".join(long[i] for i in (1, 3, 4)), "done"), ("a", "\n\n".join(long[i] for i in (6, 7)), "quiet"),
        (None, "\n\n".join([long[2], "y", long[5], "z"]), "quiet"), ("null", "x", "done")}
    assert len(got) == 4
