"""Replies grouped into exchanges.

An exchange opens with an answer. It closes on ``/done``, or when nothing more
was said for the quiet time, or at the deadline; if the talk goes on across the
deadline, the next exchange opens there. Blank messages and other commands are
not answers, and a repeated update is one message.
"""

from __future__ import annotations

import datetime as dt
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

QUIET = dt.timedelta(minutes=30)
DEADLINE = dt.timedelta(hours=24)
_SLICE = 3600


def messages(updates: DataFrame, after: int = -1) -> DataFrame:
    """(update_id, chat_id, ts, text, done): answers and closing commands only."""
    text = F.btrim(F.coalesce("text", F.lit("")))
    rows = (
        updates.filter(F.col("update_id") > after)
        .withColumns({"text": text, "ts": F.col("ts").cast("timestamp")})
        .withColumn("done", F.lower("text").startswith("/done"))
    )
    return rows.filter((F.col("text") != "") & (F.col("done") | ~F.col("text").startswith("/"))).select(
        "update_id", "chat_id", "ts", "text", "done"
    )


def _numbered(rows: DataFrame, quiet: dt.timedelta) -> DataFrame:
    """Add ``session``: how many exchanges of the chat have opened so far.

    A chat may hold a third of all messages, so nothing is ordered per chat: the
    rows are ordered inside hour slices, and each slice learns from a table of
    slices what came before it.
    """
    sliced = rows.withColumn("slice", F.floor(F.unix_timestamp("ts") / _SLICE))
    order = F.struct("ts", "update_id")
    ends = sliced.groupBy("chat_id", "slice").agg(
        F.max(F.struct("ts", "update_id", "done")).alias("last")
    )
    by_slice = Window.partitionBy("chat_id").orderBy("slice")
    before = ends.withColumn("prior", F.lag("last").over(by_slice)).select("chat_id", "slice", "prior")
    inside = Window.partitionBy("chat_id", "slice").orderBy(order)
    linked = sliced.join(before, ["chat_id", "slice"]).withColumns({
        "prev_ts": F.coalesce(F.lag("ts").over(inside), F.col("prior.ts")),
        "prev_done": F.coalesce(F.lag("done").over(inside), F.col("prior.done")),
    })
    gone_quiet = (F.unix_micros("ts") - F.unix_micros("prev_ts")) >= int(quiet.total_seconds() * 1_000_000)
    fresh = F.col("prev_ts").isNull() | F.col("prev_done") | gone_quiet
    flagged = linked.filter(~(F.col("done") & fresh)).withColumn(
        "opens", (fresh & ~F.col("done")).cast("long")
    )
    opened = flagged.groupBy("chat_id", "slice").agg(F.sum("opens").alias("n"))
    running = opened.withColumn("up_to", F.sum("n").over(by_slice)).select(
        "chat_id", "slice", (F.col("up_to") - F.col("n")).alias("earlier")
    )
    return flagged.join(running, ["chat_id", "slice"]).withColumn(
        "session", F.col("earlier") + F.sum("opens").over(inside)
    )


def reply_sessions(
    updates: DataFrame, quiet: dt.timedelta = QUIET, deadline: dt.timedelta = DEADLINE, after: int = -1
) -> DataFrame:
    """(chat_id, opened, closed, reason, answers, text) per exchange."""
    unique = messages(updates, after).groupBy("update_id").agg(
        F.min(F.struct("ts", "chat_id", "text", "done")).alias("m")
    )
    rows = _numbered(unique.select("update_id", "m.*"), quiet)
    starts = rows.groupBy("chat_id", "session").agg(F.min("ts").alias("start"))
    limit = int(deadline.total_seconds())
    piece = F.floor((F.unix_micros("ts") - F.unix_micros("start")) / (limit * 1_000_000))
    placed = rows.join(starts, ["chat_id", "session"]).withColumn("piece", piece)
    grouped = placed.groupBy("chat_id", "session", "piece").agg(
        F.min("start").alias("start"),
        F.max(F.when(~F.col("done"), F.col("ts"))).alias("last"),
        F.min(F.when(F.col("done"), F.col("ts"))).alias("done_at"),
        F.count_if(~F.col("done")).alias("answers"),
        F.array_sort(
            F.collect_list(F.when(~F.col("done"), F.struct("ts", "update_id", "text")))
        ).alias("said"),
    )
    opened = F.timestamp_micros(F.unix_micros("start") + F.col("piece") * F.lit(limit * 1_000_000))
    shown = grouped.filter("answers > 0").withColumn("opened", opened)
    quiet_at = F.timestamp_micros(F.unix_micros("last") + int(quiet.total_seconds() * 1_000_000))
    late_at = F.timestamp_micros(F.unix_micros("opened") + limit * 1_000_000)
    return shown.select(
        "chat_id",
        "opened",
        F.coalesce("done_at", F.least(quiet_at, late_at)).alias("closed"),
        F.when(F.col("done_at").isNotNull(), "done").when(quiet_at <= late_at, "quiet").otherwise("deadline").alias("reason"),
        "answers",
        answers_text(F.col("said")).alias("text"),
    )


def answers_text(said):
    """The answers in the order they came, joined by a blank line."""
    return F.array_join(F.transform(said, lambda s: s["text"]), "\n\n")


# --- the stream ---------------------------------------------------------------------------
#
# A chat may hold a third of all messages, and its state is one task's work. So messages are first cut into
# stretches: the answers of a chat within a slice of ten minutes and without a closing command, sorted and packed into
# one text. That work is spread by chat and slice. What the chat's own task walks is one row for each stretch, and
# the answers stay packed until the exchange has come out. Each call to the state is a message to the store, so chats
# are dealt to groups: what is open in a group is one value and has one timer.

_STRETCH = "chat_id string, ts timestamp, first long, id long, last long, last_id long, done boolean, n long, said array<struct<at: long, id: long, text: string>>"
_CLOSED = "chat_id string, opened long, closed long, reason string, answers long, pieces array<string>"
_WALKED = ["chat_id", "first", "id", "last", "last_id", "done", "n", "said"]
_SAID = "array<struct<at: bigint, id: bigint, text: string>>"
_MILLI, _SECOND = 1_000, 1_000_000
_LAST_ID = (1 << 63) - 1
#: Chats are dealt to so many groups, each one value of the state.
CHAT_GROUPS = 4096
#: Characters of an open exchange that its group's value may hold; more are stored beside it, so they are written once.
_HELD = 1 << 16
#: Characters of answers that leave in one frame.
_FRAME = 1 << 20


def stretches(batches: Iterator[pa.RecordBatch], slice_us: int) -> Iterator[pa.RecordBatch]:
    """Pack the messages of one partition of a batch; a repeated update counts once."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    table = table.group_by(["chat_id", "ts", "update_id"], use_threads=False).aggregate([("text", "min"), ("done", "max")])
    table = table.sort_by([("chat_id", "ascending"), ("ts", "ascending"), ("update_id", "ascending")]).combine_chunks()
    at = table.column("ts").cast(pa.int64()).to_numpy()
    ids = table.column("update_id").to_numpy()
    chat = table.column("chat_id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
    done = table.column("done_max").to_numpy()
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = (chat[1:] != chat[:-1]) | (at[1:] // slice_us != at[:-1] // slice_us) | done[1:] | done[:-1]
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(at))
    closing = done[begin]
    # a closing command is a stretch without answers
    lengths = np.where(closing, 0, end - begin)
    said = table.filter(pa.array(~done))
    packed = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
        pa.StructArray.from_arrays(
            [pa.array(at[~done]), said.column("update_id").combine_chunks(), said.column("text_min").combine_chunks()],
            names=["at", "id", "text"]))
    yield from pa.table({
        "chat_id": table.column("chat_id").take(pa.array(begin)), "ts": table.column("ts").take(pa.array(end - 1)),
        "first": at[begin], "id": ids[begin], "last": at[end - 1], "last_id": ids[end - 1], "done": closing, "n": lengths,
        "said": packed,
    }).to_batches()


@dataclass
class Chat:
    """What the state has of a chat."""

    #: When the open exchange opened, its last answer, and how many it has.
    open: tuple[int, int, int] | None = None
    #: Its packed answers, and in how many parts earlier ones are stored beside the group.
    said: list[str] = field(default_factory=list)
    stored: int = 0
    #: Up to when the chat has come out: what is not after it came late, or again.
    until: tuple[int, int] | None = None


def _frames(closed: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Closed exchanges as frames: a row by itself costs more on its way than its work here."""
    columns = [c.split()[0] for c in _CLOSED.split(", ")]
    held, size = [], 0
    for row in closed:
        held.append(row)
        size += 100 + sum(map(len, row[-1]))
        if size >= _FRAME:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


class Exchanges(StatefulProcessor):
    """One open exchange per chat. The chats of a group are one value, with one timer at the first end that is due."""

    def __init__(self, quiet: dt.timedelta, deadline: dt.timedelta):
        self.quiet, self.deadline = (round(t.total_seconds() * _SECOND) for t in (quiet, deadline))

    def init(self, handle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "chats string, due long")
        self.stored = handle.getMapState("stored", "chat string, part long", "said string")

    def handleInputRows(self, key, rows, timerValues):
        return _frames(self._taken(rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return _frames(self._expired(timerValues))

    def close(self) -> None:
        pass

    def _taken(self, frames: Iterator[pd.DataFrame], timers) -> Iterator[tuple]:
        chats, due = self._read()
        fresh = defaultdict(list)
        for frame in frames:
            for name, first, at_id, last, last_id, done, n, said in zip(*(frame[c].tolist() for c in _WALKED)):
                fresh[name if isinstance(name, str) else None].append(((first, at_id), (last, last_id), done, n, said))
        for name, todo in fresh.items():
            chat = chats.setdefault(name, Chat())
            yield from self._walk(name, chat, sorted(todo, reverse=True))
            if sum(map(len, chat.said)) > _HELD:
                # packed answers are lists in JSON
                self.stored.updateValue((json.dumps(name), chat.stored), ("[" + ",".join(p[1:-1] for p in chat.said) + "]",))
                chat.said, chat.stored = [], chat.stored + 1
        self._write(chats, due, timers)

    def _expired(self, timers) -> Iterator[tuple]:
        mark = timers.getCurrentWatermarkInMs() * _MILLI
        chats, _ = self._read()
        for name, chat in chats.items():
            if chat.open is not None:
                at, reason = self._due(chat.open)
                if at <= mark:
                    if chat.open[2]:
                        yield self._closed(name, chat, at, reason)
                    chat.open = None
            # the stream's own watermark keeps older messages out from here on
            if chat.until is not None and chat.until[0] < mark:
                chat.until = None
        self._write(chats, None, timers)

    def _walk(self, name, chat: Chat, todo: list) -> Iterator[tuple]:
        """Take the stretches of a chat in, the last of the list first; what closes comes out."""
        while todo:
            first, last, done, n, said = todo.pop()
            until = chat.until
            if until is not None and first <= until:
                if last > until:
                    todo.append(self._part(said, lambda m: m > until))
                continue
            if chat.open is not None:
                at, reason = self._due(chat.open)
                if first[0] >= at:
                    opened, latest, answers = chat.open
                    if answers:
                        yield self._closed(name, chat, at, reason)
                        chat.until = (at - 1, _LAST_ID)
                    # talk that goes on past the deadline carries over
                    going = reason == "deadline" and first[0] < latest + self.quiet
                    step = (first[0] - opened) // self.deadline * self.deadline
                    chat.open = (opened + step, first[0], 0) if going else None
            if done:
                if chat.open is not None and chat.open[2]:
                    yield self._closed(name, chat, first[0], "done")
                    chat.until = first
                chat.open = None
                continue
            late = ((first[0] if chat.open is None else chat.open[0]) + self.deadline, -1)
            if first < late <= last:
                todo += [self._part(said, lambda m: m >= late), self._part(said, lambda m: m < late)]
                continue
            chat.said.append(said)
            opened, latest, answers = chat.open or (first[0], last[0], 0)
            chat.open = (min(opened, first[0]), max(latest, last[0]), answers + n)

    def _due(self, state):
        quiet, late = state[1] + self.quiet, state[0] + self.deadline
        return (quiet, "quiet") if quiet <= late else (late, "deadline")

    def _closed(self, name, chat: Chat, at: int, reason: str) -> tuple:
        """The exchange as a row; its answers leave the state."""
        pieces, parts = [], [(json.dumps(name), i) for i in range(chat.stored)]
        for part in parts:
            pieces.append(self.stored.getValue(part)[0])
            self.stored.removeKey(part)
        pieces, chat.said, chat.stored = pieces + chat.said, [], 0
        return name, chat.open[0], at, reason, chat.open[2], pieces

    @staticmethod
    def _part(said: str, wanted):
        """A stretch of some of the answers of another one."""
        some = [m for m in json.loads(said) if wanted((m["at"], m["id"]))]
        first, last = ((m["at"], m["id"]) for m in (some[0], some[-1]))
        return first, last, False, len(some), json.dumps(some)

    def _read(self) -> tuple[dict[str | None, Chat], int | None]:
        value = self.group.get()
        if value is None:
            return {}, None
        # a chat may have no name, which no key of a JSON object can say
        return {name: Chat(open and tuple(open), said, stored, until and tuple(until))
                for name, open, said, stored, until in json.loads(value[0])}, value[1]

    def _write(self, chats: dict[str | None, Chat], due: int | None, timers) -> None:
        """Store the group, with its timer moved where something is due before it."""
        chats = {name: c for name, c in chats.items() if c.open is not None or c.until is not None}
        if not chats:
            self.group.clear()
            if due is not None:
                self.handle.deleteTimer(due)
            return
        ends = [self._due(c.open)[0] // _MILLI for c in chats.values() if c.open is not None]
        ends += [c.until[0] // _MILLI + 1 for c in chats.values() if c.until is not None]
        soonest = max(min(ends), timers.getCurrentWatermarkInMs() + 1)
        if due is None or soonest < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(soonest)
            due = soonest
        self.group.update((json.dumps([[name, c.open, c.said, c.stored, c.until] for name, c in chats.items()]), due))


def reply_sessions_stream(
    updates: DataFrame, delay: str = "10 minutes", quiet: dt.timedelta = QUIET, deadline: dt.timedelta = DEADLINE,
    groups: int = CHAT_GROUPS,
) -> DataFrame:
    """The same exchanges from a stream; an exchange comes out once it closed.

    Messages may come out of order by ``delay``: answers of an open exchange are put in order when it comes out. What is
    not after an exchange that has come out, as a repeated update, is dropped. State is kept for ``groups`` groups of chats,
    a number that a checkpoint fixes. Start the query with ``runner.STATEFUL``: the state needs a store with maps and timers.
    """
    slice_us = min(round(quiet.total_seconds() * _SECOND), 600 * _SECOND)
    said = messages(updates)
    slot = F.floor(F.unix_micros("ts") / slice_us)
    packed = (
        said.repartition("chat_id", slot).mapInArrow(lambda batches: stretches(batches, slice_us), _STRETCH)
        .withColumn("said", F.to_json("said")).withWatermark("ts", delay))
    grouped = packed.withColumn("chats", F.pmod(F.xxhash64("chat_id"), F.lit(groups))).groupBy("chats")
    closed = grouped.transformWithStateInPandas(Exchanges(quiet, deadline), _CLOSED, "append", "eventTime")
    # an update that came again while the exchange was open is in it twice
    answers = F.array_sort(F.array_distinct(F.flatten(F.transform("pieces", lambda p: F.from_json(p, _SAID)))))
    return closed.withColumn("pieces", answers).select(
        "chat_id", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("closed").alias("closed"), "reason",
        F.size("pieces").cast("long").alias("answers"), answers_text(F.col("pieces")).alias("text"))
