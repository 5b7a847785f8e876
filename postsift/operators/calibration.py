"""Did the scores mean anything? Outcomes joined to what was scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.operators import similarity as sim
from postsift.session import cut_lineage


def classify_status(status: Column) -> Column:
    """A free-text status as one of the classes; the first hit in order wins."""
    lowered = F.lower(tx.text_or_empty(status))
    out = F.lit("other")
    for name, hints in reversed(fixed.STATUS_CLASSES):
        out = F.when(tx.contains_any(lowered, hints), F.lit(name)).otherwise(out)
    return out


# --- the join -----------------------------------------------------------------------------


def _plain_words(col: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(tx.text_or_empty(col)), "[^a-z0-9]+", " "))
    return F.array_distinct(tx.words_of(plain))


def title_tokens(col: Column) -> Column:
    """Distinct words of a title minus the ones without identity. No folding here."""
    noise = F.array(*[F.lit(w) for w in fixed.TITLE_NOISE])
    return F.array_except(_plain_words(col), noise)


def company_tokens(col: Column) -> Column:
    """The words that identify an employer; the plain words if none are left."""
    noise = F.array(*[F.lit(w) for w in dict.fromkeys(fixed.EMPLOYER_NOISE)])
    return tx.let(
        _plain_words(col),
        lambda words: tx.let(
            F.array_except(F.filter(words, lambda w: F.length(w) > 1), noise),
            lambda distinct: F.when(F.size(distinct) > 0, distinct).otherwise(words),
        ),
    )


def _profiles(rows: DataFrame, key: str, best: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with their profile, one row per distinct profile).

    A profile is the two token sets: rows that share both match alike, so copies
    are joined once.
    """
    sets = rows.withColumns({
        "t": F.array_sort(title_tokens(F.col("title"))),
        "c": F.array_sort(company_tokens(F.col("company"))),
    }).withColumn("profile", F.concat_ws("|", F.array_join("t", " "), F.array_join("c", " ")))
    distinct = sets.groupBy("profile").agg(
        F.min(F.col(key).cast("string")).alias("id"),
        F.first("t").alias("tokens"),
        F.first("c").alias("names"),
        F.min(best).alias("best"),
    )
    return sets.drop("t", "c"), distinct


def match_outcomes(
    outcomes: DataFrame, scored: DataFrame, floor: float = fixed.MIN_SIMILARITY
) -> DataFrame:
    """Every outcome with the scored posting it came from, or nulls.

    Companies that are both named must share a word; when one is not named, only
    an almost equal title will do. The most similar title wins, then the earliest
    ``first_seen``, then ``job_id``. ``outcomes`` needs ``outcome_id``.
    """
    named_rows, left = _profiles(outcomes, "outcome_id", F.struct(F.lit(1).alias("unused")))
    _, right = _profiles(
        scored.filter("score IS NOT NULL"), "job_id", F.struct("first_seen", "job_id", "score")
    )
    # Read by several joins each: written once. What is compared is titles: equal ones share an id.
    left, right = (cut_lineage(side.withColumn("title", F.xxhash64("tokens"))) for side in (left, right))

    # Where titles may meet: in each word of a company; a row without a company with all, and with none.
    nameless = F.size("names") == 0
    words = F.transform("names", lambda w: F.concat(F.lit("word "), w))
    ours = left.withColumn("block", F.explode(F.when(nameless, F.array(F.lit("any"))).otherwise(F.array_append(words, "none"))))
    theirs = right.withColumn("block", F.explode(
        F.when(nameless, F.array(F.lit("any"), F.lit("none"))).otherwise(F.array_append(words, "any"))))
    strict = max(fixed.UNNAMED_SIMILARITY, floor)
    least = F.when(F.col("block").startswith("word "), F.lit(floor)).otherwise(F.lit(strict))
    hits = _best_titles(ours, theirs, least)
    best = hits.groupBy("profile").agg(F.min("hit").alias("hit"))
    found = best.select(
        "profile",
        F.col("hit.best.job_id").alias("job_id"),
        F.col("hit.best.score").alias("score"),
        F.col("hit.best.first_seen").alias("first_seen"),
        F.bround(-F.col("hit.away"), 2).alias("similarity"),
    )
    return named_rows.join(found, "profile", "left").drop("profile")


def _best_titles(ours: DataFrame, theirs: DataFrame, floor: Column) -> DataFrame:
    """(profile, hit): the best posting of the most similar titles that a profile meets in one of its blocks.

    A set of a profile and a block is one set to the search, so a title that is best in one block does not hide
    another block's.
    """
    def titles(side: DataFrame, *more: Column) -> DataFrame:
        return side.groupBy("block", F.col("title").alias("id")).agg(F.first("tokens").alias("tokens"), *more)

    met = sim.best_in_block(titles(ours), titles(theirs, F.min("best").alias("best")), floor, cut_lineage).select(
        "block", F.col("id").alias("title"), F.struct((-F.col("similarity")).alias("away"), "best").alias("hit"))
    return ours.select("block", "title", "profile").join(met, ["block", "title"]).select("profile", "hit")


# --- the report ------------------------------------------------------------------------------


def band_of(score: Column) -> Column:
    out = F.lit(fixed.LOWEST_BAND)
    for low, label in reversed(fixed.CALIBRATION_BANDS):
        out = F.when((score >= low) & (score < 101), F.lit(label)).otherwise(out)
    return out


def reached_interview(status_class: Column, status: Column) -> Column:
    """Did anybody want to talk? A rejection after a conversation counts."""
    return status_class.isin(*fixed.CONVERTED_CLASSES) | tx.contains_any(
        F.lower(tx.text_or_empty(status)), fixed.INTERVIEW_PHRASES
    )


def _sent(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("score").isNotNull() & F.col("class").isin(*fixed.SENT_CLASSES))


def calibration_table(matched: DataFrame) -> DataFrame:
    """Per score band, over what was sent and matched: counts and rates."""
    talked = reached_interview(F.col("class"), F.col("status"))
    return (
        _sent(matched)
        .groupBy(band_of(F.col("score")).alias("band"))
        .agg(
            F.count("*").alias("sent"),
            F.count_if(talked).alias("interviews"),
            F.count_if(F.col("class") == "offer").alias("offers"),
        )
        .withColumns({
            "interview_rate": F.lit(100.0) * F.col("interviews") / F.col("sent"),
            "offer_rate": F.lit(100.0) * F.col("offers") / F.col("sent"),
        })
    )


def calibration_verdict(table: DataFrame) -> DataFrame:
    """Is the top band's interview rate really above the bottom band's?"""
    order = F.array_position(
        F.array(*[F.lit(label) for _, label in fixed.CALIBRATION_BANDS], F.lit(fixed.LOWEST_BAND)), F.col("band")
    )
    one = table.withColumn("place", order).agg(
        F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"),
        F.count("*").alias("bands"),
        (F.min_by("interview_rate", "place") - F.max_by("interview_rate", "place")).alias("spread"),
    )
    verdict = (
        F.when((F.col("sent") < fixed.MIN_SENT) | (F.col("bands") < 2), "insufficient")
        .when(F.col("spread") >= fixed.SEPARATION_POINTS, "separating")
        .when(F.col("spread") <= -fixed.SEPARATION_POINTS, "inverted")
        .otherwise("flat")
    )
    return one.withColumn("verdict", verdict)


def calibration_evidence(matched: DataFrame, threshold: float = 70) -> DataFrame:
    """What the table leaves out, as counts."""
    hit = F.col("score").isNotNull()
    skipped = hit & (F.col("class") == "withdrawn")
    return matched.agg(
        F.count_if(hit & (F.col("class") == "other")).alias("in_flight"),
        F.count_if(~hit).alias("unmatched"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(skipped & (F.col("score") >= threshold)).alias("skipped_above"),
    )


def weak_joins(matched: DataFrame, below: float = 0.75) -> DataFrame:
    return _sent(matched).filter(F.col("similarity") < below).orderBy("similarity", "outcome_id")
