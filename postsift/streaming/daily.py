"""Daily counts and the sliding memory of advert keys, batch and streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from postsift.operators.keyed import first_n_per_key


def daily_funnel_stream(scored: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per day: how many were scored and the best score."""
    days = scored.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"))
    return days.agg(F.count("*").alias("n"), F.max("score").alias("best")).select(
        F.to_date("w.start").alias("day"), "n", "best"
    )


# --- the sliding memory -------------------------------------------------------------------

_DAY_MS = 86_400_000
#: Keys are dealt to so many groups, each one value of the state.
KEY_GROUPS = 4096
_FIRST = "content_key string, ts timestamp, day long, at long, pos long, payload string"


def first_of_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key and day of each Arrow batch, so that a busy key sends a few rows."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch]).sort_by([("at", "ascending"), ("pos", "ascending")])
            rows = rows.append_column("i", pa.array(np.arange(len(rows))))
            first = rows.group_by(["content_key", "day"], use_threads=False).aggregate([("i", "min")]).column("i_min")
            yield from rows.take(first.combine_chunks().sort()).drop_columns(["i"]).combine_chunks().to_batches()


class SlidingMemory(StatefulProcessor):
    """Per key the day it was last kept, and the first row of every later day that may still change.

    Each call to the state is a message to the store, so keys are dealt to groups: the keys of a group are one value and
    have one timer, at the first day that may be decided or forgotten. A day is decided when the watermark has passed its
    end, in the order of days, so rows that come late, but not too late, count as if they had come in time. What a kept day
    covers is forgotten once the watermark is past it.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle) -> None:
        self.handle = handle
        #: {key: [day kept or null, {day: [at, pos, payload]}]}, and when the timer is due
        self.memory = handle.getValueState("memory", "keys string, due long")

    def handleInputRows(self, key, rows, timerValues):
        keys, due = self._read()
        changed = False
        for row in rows:
            # not filtered before: such rows would be dropped before they move the watermark
            if row.content_key is None:
                continue
            held = keys.get(row.content_key)
            if held is None:
                held = keys[row.content_key] = [None, {}]
            if held[0] is None or row.day > held[0] + self.days:
                first, day = [row.at, row.pos, row.payload], str(row.day)
                if day not in held[1] or first < held[1][day]:
                    held[1][day] = first
                    changed = True
        if changed:
            self._write(keys, due, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        keys, _ = self._read()
        for name, held in list(keys.items()):
            for day in sorted(d for d in map(int, held[1]) if (d + 1) * _DAY_MS <= mark):
                first = held[1].pop(str(day))
                if held[0] is None or day > held[0] + self.days:
                    held[0] = day
                    yield Row(content_key=name, day=day, payload=first[2])
            if held[0] is not None and (held[0] + self.days + 1) * _DAY_MS <= mark:
                held[0] = None
            if held[0] is None and not held[1]:
                del keys[name]
        self._write(keys, None, timerValues)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[dict[str, list], int | None]:
        stored = self.memory.get()
        return (json.loads(stored[0]), stored[1]) if stored is not None else ({}, None)

    def _write(self, keys: dict[str, list], due: int | None, timers) -> None:
        """Store the group, with its timer moved where something is due before it."""
        if not keys:
            self.memory.clear()
            return
        ends = [(min(map(int, days)) + 1 if days else kept + self.days + 1) * _DAY_MS for kept, days in keys.values()]
        soonest = max(min(ends), timers.getCurrentWatermarkInMs() + 1)
        if due is None or soonest < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(soonest)
            due = soonest
        self.memory.update((json.dumps(keys), due))


def lookback_dedup_stream(rows: DataFrame, days: int = 7, delay: str = "1 day", groups: int = KEY_GROUPS) -> DataFrame:
    """:func:`lookback_dedup` over a stream: exact by day for rows up to ``delay`` late.

    A row comes out when the watermark has passed the end of its day. Rows without a key move the watermark and are
    dropped. State is kept for ``groups`` groups of keys, a number that a checkpoint fixes. Start the query with
    ``runner.STATEFUL``: the state needs a store with timers.
    """
    columns = rows.columns
    slim = rows.withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.col("content_key").cast("string").alias("content_key"), "ts",
        F.floor(F.unix_millis("ts") / _DAY_MS).cast("long").alias("day"), F.unix_micros("ts").alias("at"), "pos",
        F.to_json(F.struct(*columns)).alias("payload"))
    firsts = slim.mapInArrow(first_of_days, _FIRST).withWatermark("ts", delay)
    grouped = firsts.withColumn("keys", F.pmod(F.xxhash64("content_key"), F.lit(groups))).groupBy("keys")
    kept = grouped.transformWithState(
        SlidingMemory(days), "content_key string, day long, payload string", "append", "eventTime")
    return kept.select(F.from_json("payload", rows.schema).alias("r")).select("r.*")


def lookback_dedup(rows: DataFrame, days: int = 7) -> DataFrame:
    """The batch form, exact: after a key is kept, its rows up to ``days`` later
    are repeats; the next one after that is kept again.

    Decided on the distinct days of each key, of which there are at most as many
    as the table spans, however many rows the key has.
    """
    dated = rows.withColumn("day", F.to_date("ts"))
    seen = dated.groupBy("content_key").agg(F.array_sort(F.collect_set("day")).alias("days"))
    none = F.array().cast("array<date>")
    kept = F.aggregate(
        "days",
        none,
        lambda got, day: F.when(
            (F.size(got) == 0) | (F.datediff(day, F.try_element_at(got, F.lit(-1))) > days),
            F.array_append(got, day),
        ).otherwise(got),
    )
    wanted = seen.select("content_key", F.explode(kept).alias("day"))
    firsts = first_n_per_key(dated, ["content_key", "day"], [F.col("ts"), F.col("pos")])
    return firsts.join(wanted, ["content_key", "day"], "left_semi").drop("day")
