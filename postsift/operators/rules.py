"""Rule filters that run before anything expensive."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.schema import Rules

_FEW = 16


def prefilter_keywords(searches: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Distinct keywords: words of the search terms, plus the extras verbatim."""
    stop = list(fixed.STOP_WORDS) + [w.strip().lower() for w in rules.extra_stop_words if w.strip()]
    words = searches.select(
        F.explode(F.split(F.lower(tx.text_or_empty(F.col("term"))), r"(?U)\s+")).alias("w")
    ).select(F.btrim("w", F.lit(".,;:()\"'")).alias("keyword"))
    out = words.filter((F.length("keyword") >= 3) & ~F.col("keyword").isin(stop))
    extras = [w.strip().lower() for w in rules.extra_keywords]
    extras = [(w,) for w in extras if w and w not in stop]
    if extras:
        out = out.unionByName(searches.sparkSession.createDataFrame(extras, "keyword string"))
    return out.distinct()


def mentions_any(col: Column, keywords) -> Column:
    """Any keyword as a substring. Long lists become one alternation."""
    if len(keywords) <= _FEW:
        return tx.contains_any(col, keywords)
    body = "|".join(re.sub(r"([^\w\s])", r"\\\1", k) for k in keywords)
    return col.rlike(body)


def passes_location(location: Column, rules: Rules) -> Column:
    """An empty location passes, a keep pattern wins, an exclusion drops."""
    place = F.lower(tx.text_or_empty(location))
    keep = tx.matches_any(place, [p.lower() for p in rules.keep_locations], rules.whole_word)
    drop = tx.matches_any(place, [p.lower() for p in rules.exclude_locations], rules.whole_word)
    return (place == "") | keep | ~drop


def title_excluded(title: Column, rules: Rules) -> Column:
    lowered = F.lower(tx.text_or_empty(title))
    return tx.matches_any(lowered, [p.lower() for p in rules.exclude_titles], rules.whole_word)


def passes_prefilter(title: Column, description: Column, keywords, rules: Rules) -> Column:
    """No excluded title, and any keyword in title or whole description."""
    excluded = title_excluded(title, rules)
    if not rules.use_prefilter or not keywords:
        return ~excluded
    text = F.lower(F.concat(tx.text_or_empty(title), F.lit(" "), tx.text_or_empty(description)))
    return ~excluded & mentions_any(text, list(keywords))


def route_status(rows: DataFrame, keywords, rules: Rules) -> DataFrame:
    """Add ``status`` and ``score``: rejected rows get 0, the others are null
    and go on to scoring."""
    status = F.when(~passes_location(F.col("location"), rules), "rejected_location").when(
        ~passes_prefilter(F.col("title"), F.col("description"), keywords, rules), "rejected_prefilter"
    )
    return rows.withColumn("status", status).withColumn(
        "score", F.when(F.col("status").isNotNull(), F.lit(0))
    )


def limit_new(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("pos").limit(n)


def select_matched(scored: DataFrame, threshold: int) -> DataFrame:
    """New rows at or above the threshold, best first, arrival order within."""
    hit = (F.col("status") == "new") & (F.col("score").cast("int") >= threshold)
    return scored.filter(hit).orderBy(F.col("score").cast("int").desc(), "pos")


def pick(matched: DataFrame, min_score: int, top_n: int) -> DataFrame:
    """The first rows above a second, higher bar."""
    return (
        matched.filter(F.col("score").cast("int") >= min_score)
        .orderBy(F.col("score").cast("int").desc(), "pos")
        .limit(top_n)
    )


def score_label(score: Column, strong: int = 80, possible: int = 65) -> Column:
    return F.when(score >= strong, "STRONG").when(score >= possible, "POSSIBLE").otherwise("LONG SHOT")
