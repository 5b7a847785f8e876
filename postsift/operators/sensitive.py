"""Credentials and private terms: redaction and scans.

A finding says where something is and which entry it is. It never holds a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.operators.keyed import first_n_per_key
from postsift.session import cut_lineage

#: Lines numbered by one task at a time.
SLICE_LINES = 65_536


def redact(col: Column) -> Column:
    """Every known credential shape replaced, in list order; null reads ''."""
    out = tx.text_or_empty(col)
    for pattern, replacement in fixed.REDACTIONS:
        # The replacement keeps its own group only where it names one.
        safe = replacement if replacement.startswith("$1") else replacement.replace("$", r"\$")
        out = F.regexp_replace(out, pattern, safe)
    return out


def lines_of(docs: DataFrame, path: str, text: str, first: int = 1) -> DataFrame:
    """(path, line, content): one row per line, numbered from ``first``."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), tx.LINE_END)
    return docs.select(F.col(path).alias("path"), F.posexplode(split).alias("i", "content")).select(
        "path", (F.col("i") + first).cast("long").alias("line"), "content"
    )


def scan_secrets(lines: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(path, line, label, evidence): the first match per line and shape."""
    shapes = F.array(*[
        F.struct(
            F.lit(label).alias("label"),
            F.regexp_extract(F.col("content"), pattern, 0).alias("shown"),
        )
        for label, pattern in fixed.SECRET_SHAPES
    ])
    rows = lines.filter(~F.col("content").contains(fixed.ALLOW_MARKER))
    if exempt:
        rows = rows.filter(~F.col("path").isin(*exempt))
    found = rows.select("path", "line", F.explode(F.filter(shapes, lambda s: s["shown"] != "")).alias("s"))
    evidence = F.concat(F.substring("s.shown", 1, 12), F.lit("..."), F.right(F.col("s.shown"), F.lit(4)))
    return found.select("path", "line", F.col("s.label").alias("label"), evidence.alias("evidence"))


def forbidden_path(path: Column) -> Column:
    """Why a path must not be published, or null. The first rule that fits wins."""
    out = F.lit(None).cast("string")
    for pattern, reason in reversed(fixed.FORBIDDEN_PATHS):
        out = F.when(path.rlike(pattern), F.lit(reason)).otherwise(out)
    return out


# --- spellings of one identifier -----------------------------------------------------------


def _spelled(lowered: Column, which: int) -> Column:
    out = lowered
    for letter, spellings in fixed.TRANSLITERATIONS.items():
        out = F.replace(out, F.lit(letter), F.lit(spellings[which]))
    return tx.fold_ascii(out)


def _forms(item: Column) -> Column:
    """The text in lower case, then its other spellings in order."""

    def spell(lowered: Column) -> Column:
        others = F.array_distinct(F.array(_spelled(lowered, 0), _spelled(lowered, 1)))
        return F.concat(F.array(lowered), F.array_sort(F.filter(others, lambda o: o != lowered)))

    return tx.let(F.lower(F.btrim(item)), spell)


def term_variants(kind: Column, value: Column) -> Column:
    """Every spelling of one identifier worth listing, the value itself first."""
    given = F.btrim(tx.text_or_empty(value))
    none = F.lit(None).cast("string")
    words = F.filter(F.split(given, r"(?U)\s+"), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    several = (kind == "name") & (F.size(words) >= 2)
    turned = F.concat_ws(" ", last, F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "))
    compact = F.regexp_replace(given, r"(?U)[\s().\-]", "")
    phone = kind == "phone"
    local = F.substring_index(given, "@", 1)
    stem = F.when(given.contains("."), F.regexp_replace(given, r"\.[^.]*$", "")).otherwise(given)
    employer = tx.company_key(given)
    tail = F.substring_index(given, "/", -1)
    abroad = F.substr(compact, F.lit(3))
    items = F.array(
        given,
        F.when(several, turned).otherwise(none),
        F.when(several & (F.length(last) >= 4), last).otherwise(none),
        F.when((kind == "email") & given.contains("@") & (F.length(local) >= fixed.MIN_TERM_LENGTH), local).otherwise(none),
        F.when(phone, compact).otherwise(none),
        F.when(phone & compact.startswith("+"), F.substr(compact, F.lit(2))).otherwise(none),
        F.when(phone & compact.startswith("00"), F.concat(F.lit("+"), abroad)).otherwise(none),
        F.when(phone & compact.startswith("00"), abroad).otherwise(none),
        F.when((kind == "employer") & (F.length(employer) >= 4), employer).otherwise(none),
        F.when((kind == "keyfile") & (F.length(stem) >= 4), stem).otherwise(none),
        F.when((kind == "repo") & given.contains("/") & (F.length(tail) >= 4), tail).otherwise(none),
    )
    spelled = F.flatten(F.transform(F.filter(items, lambda i: i.isNotNull()), _forms))
    return F.array_distinct(F.filter(spelled, lambda s: F.length(s) >= fixed.MIN_TERM_LENGTH))


# --- term lists ---------------------------------------------------------------------------------


def term_merge(lists: DataFrame) -> DataFrame:
    """(entry, source, position, term) of several lists in order.

    ``lists`` has (list_no, source, line_no, text). Comments and blanks are not
    terms; a position counts the term lines of its own list; the first list that
    has a term keeps it.
    """
    term = F.lower(F.btrim("text"))
    rows = lists.withColumn("term", term).filter("term != '' AND NOT startswith(term, '#')")
    # A list may be long: count inside slices of it and add what came before.
    sliced = rows.withColumn("slice", F.floor(F.col("line_no") / SLICE_LINES))
    before = (
        sliced.groupBy("list_no", "slice").agg(F.count("*").alias("n"))
        .withColumn("up_to", F.sum("n").over(Window.partitionBy("list_no").orderBy("slice")))
        .select("list_no", "slice", (F.col("up_to") - F.col("n")).alias("before"))
    )
    own = Window.partitionBy("list_no", "slice").orderBy("line_no")
    placed = (
        sliced.withColumn("within", F.row_number().over(own))
        .join(before, ["list_no", "slice"])
        .withColumn("position", (F.col("before") + F.col("within")).cast("int"))
    )
    kept = first_n_per_key(placed, ["term"], [F.col("list_no"), F.col("line_no")])
    return kept.select("list_no", "source", "position", "term")


# --- the search -----------------------------------------------------------------------------
#
# A term stands in a line only if each run of q bytes of it does. One run of each term, a rare one, is its anchor. The
# anchors' bits are set in a table of fixed size that goes to the tasks; a task looks up the runs of its lines there,
# and what is found meets the terms in an equi-join on the run itself, where the whole term is looked for. So lines are read
# once and only those with an anchor are shuffled, and the list is never in one place.

#: Runs of a term of at least so many bytes; shorter terms have shorter runs.
RUN_BYTES = (8, 4, 3, 2, 1)
#: Bits of the table: 16 MB, whatever the list.
TABLE_BITS = 27
#: Bytes of lines looked up at once, and sent on at once.
BLOCK_CHARS = 1 << 20

_RUNS = "entry long, term string, q int, code long, bit long"


def _codes(data: np.ndarray, q: int) -> np.ndarray:
    """The ``q`` bytes from each place on, as one number."""
    out = np.zeros(max(len(data) - q + 1, 0), dtype=np.uint64)
    for k in range(q):
        out |= data[k: k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _bits(codes: np.ndarray, q: int, table_bits: int) -> np.ndarray:
    """Which bit of the table stands for a run."""
    mixed = (codes ^ (codes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(q)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed >> np.uint64(64 - table_bits)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), at


def _anchors(terms: DataFrame, table_bits: int) -> DataFrame:
    """(entry, term, q, code, bit): the run of each term that the fewest terms of the list have."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for entry, term in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(term.encode(), dtype=np.uint8)
                q = next(q for q in RUN_BYTES if q <= len(raw))
                codes = np.unique(_codes(raw, q))
                rows.append((np.full(len(codes), entry), [term] * len(codes), np.full(len(codes), q, np.int32), codes, _bits(codes, q, table_bits)))
            if rows:
                entries, listed, sizes, codes, bits = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(entries)), pa.array([t for some in listed for t in some], pa.string()), pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(codes).view(np.int64)), pa.array(np.concatenate(bits).view(np.int64))],
                    names=["entry", "term", "q", "code", "bit"])

    listed = terms.filter("length(term) > 0").select(F.col("entry").cast("long").alias("entry"), "term")
    every = listed.mapInArrow(runs, _RUNS)
    counts = every.groupBy("q", "code").agg(F.count("*").alias("n"))
    rarest = every.select("entry", "q", "code", "bit").join(counts, ["q", "code"]).groupBy("entry").agg(
        F.min(F.struct("n", "code", "q", "bit")).alias("best"))
    return listed.join(rarest, "entry").select("entry", "term", "best.q", "best.code", "best.bit")


def _table(anchors: DataFrame, table_bits: int) -> tuple[np.ndarray, list[int]]:
    """The bits of all anchors, of which each part is put together in Spark, and the lengths of runs in use."""
    parts = anchors.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("part"), "q").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    table, sizes = np.zeros(1 << max(table_bits, 15) - 3, dtype=np.uint8), set()
    for row in parts.toLocalIterator():
        bits = np.frombuffer(row.bits, dtype=np.uint8)
        table[(row.part - 1) * len(bits): row.part * len(bits)] |= bits
        sizes.add(row.q)
    return table, sorted(sizes)


def scan_terms(lines: DataFrame, terms: DataFrame, block_chars: int = BLOCK_CHARS, table_bits: int = TABLE_BITS) -> DataFrame:
    """(path, line, col, entry): every listed term found in a line, once.

    ``lines`` has (path, line, content), ``terms`` (entry, term) in lower case; null and blank terms are none. A table of
    2 to the power ``table_bits`` bits tells which lines may hold a term; a small one lets more lines through and changes
    nothing else. Lines are looked up a megabyte at a time, and those found are sent on in blocks of ``block_chars`` bytes;
    a longer line is a block of its own. An empty list finds nothing.
    """
    anchors = cut_lineage(_anchors(terms, table_bits))
    table, sizes = _table(anchors, table_bits)
    shared = lines.sparkSession.sparkContext.broadcast(table)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            data, at = _bytes_of(batch.column("low"))
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_CHARS, side="right")) - 1)
                found = []
                for q in sizes:
                    codes = _codes(data[at[first]: at[last]], q)
                    bit = _bits(codes, q, table_bits).astype(np.int64)
                    places = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    rows = np.searchsorted(at[first: last + 1] - at[first], places, side="right") - 1
                    inside = places + q <= at[first + 1: last + 1][rows] - at[first]
                    pairs = np.unique(np.stack([rows[inside], codes[places[inside]].view(np.int64)]), axis=1)
                    found.append((pairs[0] + first, np.full(pairs.shape[1], q, dtype=np.int32), pairs[1]))
                rows, runs, codes = (np.concatenate(x) for x in zip(*found))
                # a line goes on once for each anchor in it: in pieces of bounded size
                size = np.cumsum(at[rows + 1] - at[rows])
                cut = 0
                while cut < len(rows):
                    base = size[cut - 1] if cut else 0
                    end = max(cut + 1, int(np.searchsorted(size, base + block_chars, side="right")))
                    picked = batch.take(pa.array(rows[cut:end]))
                    yield pa.RecordBatch.from_arrays(
                        [*picked.columns, pa.array(runs[cut:end]), pa.array(codes[cut:end])], names=[*picked.schema.names, "q", "code"])
                    cut = end
                first = last

    ready = lines.select("path", "line", F.lower("content").alias("low")).filter("low IS NOT NULL")
    if not sizes:
        return ready.select("path", "line", F.lit(None).cast("long").alias("col"), F.lit(None).cast("long").alias("entry")).filter("false")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema), "q int", "code long"])
    met = ready.mapInArrow(look, schema).join(anchors.select("q", "code", "entry", "term"), ["q", "code"])
    return met.withColumn("col", F.expr("locate(term, low)").cast("long")).filter("col > 0").select("path", "line", "col", "entry")


def scan_files(
    files: DataFrame, terms: DataFrame, skip: str | None = None, most_bytes: int = fixed.MAX_FILE_BYTES
) -> DataFrame:
    """:func:`scan_terms` over (path, length, content) files; binary suffixes, files
    beyond ``most_bytes``, files with a NUL and the list itself are skipped."""
    low = F.lower("path")
    keep = F.col("length") <= most_bytes
    for suffix in fixed.BINARY_SUFFIXES:
        keep = keep & ~low.endswith(suffix)
    if skip:
        keep = keep & ~F.col("path").endswith(skip)
    text = files.filter(keep).select("path", F.decode("content", "UTF-8").alias("text"))
    readable = text.filter(~F.col("text").contains("\x00"))
    return scan_terms(lines_of(readable, "path", "text"), terms)


def scan_tree(spark: SparkSession, root: str, terms: DataFrame, skip: str | None = None) -> DataFrame:
    """:func:`scan_files` over every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return scan_files(files.select("path", "length", "content"), terms, skip)


def scan_identities(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, field, entry): the first matching entry of each identity text."""
    lines = rows.select(F.struct("id", "field").alias("path"), F.lit(0).alias("line"), F.col("text").alias("content"))
    hits = scan_terms(lines, terms)
    return hits.groupBy("path").agg(F.min("entry").alias("entry")).select("path.id", "path.field", "entry")


def added_lines(diffs: DataFrame, key: str, diff: str, slice_lines: int = SLICE_LINES) -> DataFrame:
    """(key, path, line, content): the lines a unified diff adds, numbered as in
    the new file.

    ``key`` names one diff; a null one is a key like others. A null or empty diff adds nothing. The file, the hunk and
    the place in it are found inside slices of ``slice_lines`` lines; a table with one row of each slice carries on
    what is open at its end, so no task sorts a whole diff.
    """
    rows = diffs.select(
        F.struct(F.col(key).alias("key")).alias("of"), F.posexplode(F.split(F.col(diff), "\n")).alias("i", "raw")
    )
    is_file, is_hunk = F.col("raw").startswith("+++ "), F.col("raw").startswith("@@")
    target = F.btrim(F.substr("raw", F.lit(5)))
    named = F.when(target.startswith("b/"), F.substr(target, F.lit(3))).otherwise("")
    start = F.regexp_extract("raw", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 1).try_cast("long")
    so_far = Window.partitionBy("of", "slice").orderBy("i")
    marked = rows.withColumn("slice", F.floor(F.col("i") / slice_lines)).withColumns({
        "named": F.last(F.when(is_file, named), ignorenulls=True).over(so_far),
        "begun": F.last(F.when(is_hunk, F.coalesce(start, F.lit(0))), ignorenulls=True).over(so_far),
        "hunk": F.count_if(is_hunk).over(so_far),
        "added": F.col("raw").startswith("+") & ~F.col("raw").startswith("+++"),
    })
    # the last hunk of each slice is open: its file, its start, and its added lines under the file before the slice and under one named in it
    last = marked.groupBy("of", "slice", "hunk").agg(
        F.max_by("named", "i").alias("named"), F.max_by("begun", "i").alias("begun"),
        F.count_if(F.col("added") & F.col("named").isNull()).alias("under_earlier"),
        F.count_if(F.col("added") & (F.col("named") != "")).alias("under_named"),
    )
    ends = last.groupBy("of", "slice").agg(
        F.max_by(F.struct("named", "begun", "under_earlier", "under_named"), "hunk").alias("end"), F.max("hunk").alias("hunks"))
    in_order = Window.partitionBy("of").orderBy("slice")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({
        "path_before": F.coalesce(F.last("end.named", ignorenulls=True).over(earlier), F.lit("")),
        "begun_before": F.coalesce(F.last("end.begun", ignorenulls=True).over(earlier), F.lit(0)),
        "open_hunk": F.sum("hunks").over(in_order),
    }).withColumn(
        "open_lines", F.sum(F.col("end.under_named") + F.when(F.col("path_before") != "", F.col("end.under_earlier")).otherwise(0))
        .over(Window.partitionBy("of", "open_hunk").orderBy("slice"))
    ).select("of", "slice", "path_before", "begun_before", F.lag("open_lines", 1, 0).over(in_order).alias("lines_before"))
    placed = marked.filter("added").join(carried, ["of", "slice"]).withColumn(
        "path", F.coalesce("named", "path_before")).filter("path != ''")
    before = F.row_number().over(Window.partitionBy("of", "slice", "hunk").orderBy("i")) - 1
    line = F.coalesce("begun", "begun_before") + before + F.when(F.col("hunk") == 0, F.col("lines_before")).otherwise(0)
    return placed.select(
        F.col("of.key").alias(key), "path", line.alias("line"), F.substr("raw", F.lit(2)).alias("content"))


def scan_added_lines(diffs: DataFrame, key: str, diff: str, terms: DataFrame) -> DataFrame:
    rows = added_lines(diffs, key, diff).select(F.struct(key, "path").alias("path"), "line", "content")
    return scan_terms(rows, terms).select(f"path.{key}", "path.path", "line", "col", "entry")


def employers_not_listed(companies: DataFrame, terms: DataFrame, declined: DataFrame) -> DataFrame:
    """Employers no term covers, in any spelling, and nobody declined."""
    names = companies.select("company").distinct().withColumn("low", F.lower(F.btrim("company")))
    undecided = names.join(declined.select(F.col("company").alias("low")).distinct(), "low", "left_anti")
    spelled = undecided.select("company", F.explode(term_variants(F.lit("employer"), F.col("company"))).alias("term"))
    covered = spelled.join(terms.select("term").distinct(), "term", "left_semi").select("company")
    lines = undecided.select(F.col("company").alias("path"), F.lit(1).alias("line"), F.col("low").alias("content"))
    mentioned = scan_terms(lines, terms).select(F.col("path").alias("company"))
    return undecided.join(covered.unionByName(mentioned).distinct(), "company", "left_anti").select("company")
