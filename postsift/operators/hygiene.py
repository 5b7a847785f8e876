"""Clean a posting before anything reads it, and say what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import text as tx

GUARDED = ("title", "company", "description")
LISTED_LOOKALIKES = 5


def guard(rows: DataFrame) -> DataFrame:
    """Remove invisible characters from the guarded fields and add ``guard``.

    ``clean``, ``cleaned: N invisible characters removed`` or ``flagged: ...``.
    """
    removed = sum((tx.invisible_count(F.col(c)) for c in GUARDED), F.lit(0))
    tampered = F.lit(False)
    for name in GUARDED:
        tampered = tampered | tx.tampering(F.col(name))
    mixed = F.array_sort(
        F.array_distinct(F.flatten(F.array(*[tx.lookalikes(F.col(c)) for c in GUARDED])))
    )
    found = rows.withColumn(
        "_found", F.struct(removed.alias("removed"), tampered.alias("tampered"), mixed.alias("mixed"))
    )
    cleaned = found.withColumns({c: tx.clean_invisible(F.col(c)) for c in GUARDED})
    note = F.when(
        F.col("_found.removed") > 0,
        F.concat(F.col("_found.removed").cast("string"), F.lit(" invisible characters removed")),
    )
    bidi = F.when(
        F.col("_found.tampered"), F.lit("bidi control or zero-width character inside a word")
    )
    spoof = F.when(
        F.size("_found.mixed") > 0,
        F.concat(
            F.lit("look-alike words: "),
            F.array_join(F.slice("_found.mixed", 1, LISTED_LOOKALIKES), ", "),
        ),
    )
    flagged = bidi.isNotNull() | spoof.isNotNull()
    verdict = (
        F.when(flagged, F.concat(F.lit("flagged: "), F.concat_ws("; ", bidi, spoof, note)))
        .when(note.isNotNull(), F.concat(F.lit("cleaned: "), note))
        .otherwise(F.lit("clean"))
    )
    return cleaned.withColumn("guard", verdict).drop("_found")


def is_flagged(verdict: Column) -> Column:
    return verdict.startswith("flagged")
