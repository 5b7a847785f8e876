"""What each filter removes in every order of filters, by min-plus products of removal ranks.

A document fails some of k filters; that is one of 2**k masks. Written as a row of
zeros (fails) and infinities (passes), a mask matrix meets the position matrix (the
step at which each order applies each filter: the inverse permutations) in a min-plus
product, whose entry is the step at which an order removes documents of that mask.
The counts of the masks, scattered to these steps, give what each step removes, keeps
and loses; what fails a filter but went earlier is redundant there.

Spark counts documents by part and mask, so the products work on 2**k counts a part,
whatever the number of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import arrow_map, stored

#: More filters than this have too many orders to list.
MOST_FILTERS = 8
#: Long texts are cut into words in slices of about so many bytes.
SLICE_BYTES = 1 << 20

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
_LATER_BYTES = bytes(range(0x80, 0xC0))
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, steps): every order of the filters, and for each mask and order the step that removes the mask.

    ``orders[o, s]`` is the filter at step ``s``. ``steps[m, o]`` is the number of filters where nothing removes ``m``.
    """
    orders = np.array(list(permutations(range(filters))), dtype=np.int64).reshape(-1, filters)
    place = np.argsort(orders, axis=1).T
    masks = np.arange(1 << filters)
    passes = np.where(masks[:, None] >> np.arange(filters) & 1, 0, filters)
    steps = np.full((len(masks), len(orders)), filters, dtype=np.int64)
    for f in range(filters):
        np.minimum(steps, passes[:, f, None] + place[f], out=steps)
    return orders, steps


def audit(
    rows: DataFrame, filters: dict[str, str], part_col: str = "part", count_col: str | None = None,
    losses: dict[str, str] | None = None,
) -> DataFrame:
    """One row per part, order of all filters and step of it.

    ``filters`` names a boolean column (true: fails; null: passes) by a short name; an order is the names put together.
    A row counts once, or ``count_col`` times. ``losses`` names a boolean column by a result column. Results (long):
    ``kept`` after the step, ``removed`` there, ``redundant`` (fails its filter, removed earlier), ``unique_fails``
    (fails its filter only), a column for each loss (removed there and marked), ``shapley`` (removed by the filter in all
    orders together). Steps count from 1; steps that remove nothing are listed too. No rows: no parts, no result.
    """
    losses, k = losses or {}, len(filters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited, not {k}")
    names, marks = list(filters), list(losses)
    count = F.lit(1) if count_col is None else F.col(count_col)
    mask = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))
    counted = rows.groupBy(F.col(part_col).alias("part"), mask.alias("mask")).agg(
        F.sum(count.cast("long")).alias("n0"),
        *(F.sum(F.when(F.col(c), count.cast("long")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(losses.values(), 1)))
    # a part has at most one row a mask, so its list is bounded
    tables = counted.groupBy("part").agg(
        F.collect_list("mask").alias("masks"), *(F.collect_list(f"n{i}").alias(f"n{i}") for i in range(len(marks) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = removal_steps(k)
        labels = pa.array(["".join(names[f] for f in order) for order in orders for _ in order], pa.string())
        step = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))
        each = np.broadcast_to(np.arange(len(orders)), steps.shape)
        fails = np.arange(1 << k)[:, None] >> np.arange(k) & 1
        for batch in batches:
            for row in batch.to_pylist():
                weight = np.zeros((len(marks) + 1, 1 << k), dtype=np.int64)
                for i in range(len(marks) + 1):
                    weight[i, row["masks"]] = row[f"n{i}"]
                taken = np.zeros((len(marks) + 1, len(orders), k + 1), dtype=np.int64)
                for i, w in enumerate(weight):
                    np.add.at(taken[i], (each, steps), w[:, None])
                removed = taken[0, :, :k]
                whole = np.zeros(k, dtype=np.int64)
                np.add.at(whole, orders, removed)
                out = [
                    weight[0].sum() - np.cumsum(removed, axis=1), removed, (weight[0] @ fails)[orders] - removed,
                    weight[0, 1 << orders], *taken[1:, :, :k], whole[orders],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(labels), pa.string()), labels, step, *(pa.array(x.ravel()) for x in out)],
                    names=columns)

    results = ["kept", "removed", "redundant", "unique_fails", *marks, "shapley"]
    columns = ["part", "filter_order", "step", *results]
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in results)
    return arrow_map(tables.withColumn("part", F.col("part").cast("string")), run, schema)


def _words(raw: bytes) -> tuple[int, int]:
    """How many words, and how many distinct ones."""
    if len(raw) <= SLICE_BYTES:
        words = raw.split()
        return len(words), len(set(words))
    seen: set[bytes] = set()
    total = at = 0
    while at < len(raw):
        stop = _WHITE.search(raw, at + SLICE_BYTES)
        end = stop.start() if stop else len(raw)
        words = raw[at:end].split()
        total += len(words)
        seen.update(words)
        at = end
    return total, len(seen)


def text_faults(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    least_words: int = 100, least_distinct: int = 80, most_upper: int = 10,
) -> DataFrame:
    """One row per document: ``id``, ``part`` (null: empty string), ``digest`` (SHA-256 of the text) and what it fails.

    ``few``: under ``least_words`` words; ``repeats``: under ``least_distinct`` per cent of its words are distinct;
    ``loud``: over ``most_upper`` per cent of its code points are A-Z; ``marks``: holds one of ``#$%&*|``. Words are runs
    of other than space and \\x09-\\x0D, upper and lower case differ. Null text counts as the empty text, which fails
    ``few`` only. Ids are passed on, null or repeated. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, flags = [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                raw = text or b""
                words, distinct = _words(raw)
                upper = len(raw) - len(raw.translate(None, _UPPER))
                points = len(raw.translate(None, _LATER_BYTES))
                digests.append(hashlib.sha256(raw).digest())
                flags.append((
                    words < least_words, 100 * distinct < least_distinct * words, 100 * upper > most_upper * points,
                    len(raw.translate(None, _MARKS)) < len(raw)))
            few, repeats, loud, marks = zip(*flags) if flags else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()),
                 *(pa.array(x, pa.bool_()) for x in (few, repeats, loud, marks))],
                names=["id", "part", "digest", "few", "repeats", "loud", "marks"])

    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, part string, digest binary, few boolean, repeats boolean, loud boolean, "
                                "marks boolean")


def faults_with_copies(faults: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts (``n``) of documents by part, the four faults, ``copy``, ``good`` and ``toxic``; some counts are negative.

    ``copy``: another document with a smaller id has the same text. Rows that share an id and a text are no copies
    of each other; without an id a row is no copy and has none. Of several label rows of an id each mark counts if one
    of them has it. Groups of copies fold before the shuffle: all rows are first counted as copies, and the first
    document of each text is then moved, so no row meets its group and a text of a third of all rows is no hot key.
    """
    kinds = ["part", "few", "repeats", "loud", "marks", "good", "toxic"]
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = faults.where("id IS NOT NULL").join(marks, "id", "left").na.fill(False, ["good", "toxic"])
    unnamed = faults.where("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    each = known.groupBy("id", "digest", *kinds).agg(F.count("*").alias("n"))
    of_id = each.groupBy("id", "digest").agg(F.collect_list(F.struct(*kinds, "n")).alias("here"))
    firsts = of_id.groupBy("digest").agg(F.min_by("here", "id").alias("here")).select(F.inline("here"))
    moved = firsts.select(*kinds, F.inline(F.array(
        F.struct(F.lit(False).alias("copy"), F.col("n").alias("n")), F.struct(F.lit(True).alias("copy"), (-F.col("n")).alias("n")))))
    rows = (
        each.select(*kinds, F.lit(True).alias("copy"), "n").unionByName(moved)
        .unionByName(unnamed.select(*kinds, F.lit(False).alias("copy"), F.lit(1).cast("long").alias("n"))))
    return rows.groupBy(*kinds, "copy").agg(F.sum("n").alias("n")).where("n <> 0")


#: The five filters of the query, by letter.
FILTERS = {"A": "few", "B": "repeats", "C": "loud", "D": "marks", "E": "copy"}


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``FILTERS`` on documents by ``lang``, with the good and toxic ones that each step loses."""
    faults = stored(text_faults(docs), "audit-faults")
    return audit(
        faults_with_copies(faults, labels), FILTERS, "part", "n", {"good_lost": "good", "toxic_lost": "toxic"})
