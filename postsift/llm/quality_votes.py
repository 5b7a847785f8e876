"""Quality by weak supervision: rules vote, their accuracies are estimated, texts get a probability.

Each rule looks at one measure of a text and votes good (1), bad (0) or abstains (null). No rule decides alone: how
often a rule is right when the text is good, and when it is bad, is estimated from how the rules agree on the texts that pass the base conditions, by
expectation-maximisation, and a text is kept if the probability that it is good is at least a half.

Texts with the same votes are alike for this, so the estimation reads a table of vote patterns with their counts, at
most three to the power of the number of rules, and every step is one aggregation of it. All of it is DataFrame
functions: measures are higher-order functions over one array of words per text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.llm.common import stored

REPEAT_WORDS = 8
BREAK = r"[\x20\x09-\x0D]"
_BREAKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = 20
#: A rule is taken to be right on most good texts, and to vote bad more often on bad texts than on good ones. This fixes
#: which of the two classes is the good one. A rule that sees one kind of bad text only may miss the others.
LEAST_GOOD, LEAST_LIFT, HIGHEST = 0.6, 0.01, 0.995
START_GOOD, START_BAD, START_SHARE = 0.95, 0.4, 0.8


@dataclass(frozen=True)
class Rule:
    """``good`` and ``bad`` are conditions on the measures; where neither holds, or both, the rule abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        good, bad = F.coalesce(F.expr(self.good), F.lit(False)), F.coalesce(F.expr(self.bad), F.lit(False))
        return F.when(good & ~bad, 1).when(bad & ~good, 0).cast("byte")


RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("symbols", "100 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    Rule("marked_words", "20 * n_marked <= n_words", "5 * n_marked > n_words"),
    Rule("repeats", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    Rule("lines", "n_dup_lines = 0", "4 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("capitals", "5 * n_capitals <= word_chars", "2 * n_capitals > word_chars"),
    Rule("digits", "20 * n_digits <= word_chars", "4 * n_digits > word_chars"),
    Rule("variety", "n_words >= 30 and 3 * n_distinct >= n_words", "n_words >= 30 and 6 * n_distinct < n_words"),
    Rule("sentences", "n_stops > 0 and 60 * n_stops >= n_words", "n_words >= 40 and n_stops = 0"),
)


def _bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _without(text: Column, letters: str) -> Column:
    return F.char_length(F.translate(text, letters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside runs of ``REPEAT_WORDS`` words that the text has twice or more."""
    size = REPEAT_WORDS

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(places, i + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(runs: Column) -> Column:
        def beside(run: Column, i: Column) -> Column:
            return (run["h"] == F.get(runs, i - 1)["h"]) | (run["h"] == F.get(runs, i + 1)["h"])

        return F.sort_array(F.transform(F.filter(runs, lambda run, i: F.coalesce(beside(run, i), F.lit(False))), lambda run: run["p"]))

    def counted(runs: Column) -> Column:
        sorted_runs = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), 0).otherwise(
            _bind(_bind(sorted_runs, repeated), covered))

    def runs_of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.slice(hashes, i, size)))

    return F.when(F.size(words) < size, 0).otherwise(
        _bind(_bind(F.transform(words, lambda w: F.xxhash64(w)), runs_of), counted))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and the measures the rules look at. Null text has no words and no lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BREAKS))
    words = F.when(F.char_length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK + "+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.char_length(F.btrim(line, F.lit(_BREAKS))) > 0)
    by_word = _bind(words, lambda w: F.struct(
        F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).alias("n_distinct"),
        F.size(F.filter(w, lambda x: F.translate(x, _SYMBOLS, "") != x)).alias("n_marked")))
    by_line = _bind(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    length = F.char_length(text)
    columns = {
        "n_words": F.col("w.n_words"), "word_chars": _without(text, _BREAKS), "n_symbols": length - _without(text, _SYMBOLS),
        "n_dup_lines": F.col("l.n_dup_lines"), "n_repeat_words": F.col("w.n_repeat_words"), "n_lines": F.col("l.n_lines"),
        "n_distinct": F.col("w.n_distinct"), "n_marked": F.col("w.n_marked"), "n_capitals": length - _without(text, _CAPITALS),
        "n_digits": length - _without(text, "0123456789"), "n_stops": length - _without(text, ".!?"),
    }
    # only doc-sized scalars leave this step
    return docs.select(F.col(id_col), F.col(text_col), by_word.alias("w"), by_line.alias("l")).select(
        F.col(id_col), *(c.cast("long").alias(name) for name, c in columns.items()))


@dataclass(frozen=True)
class Accuracies:
    """Share of good texts, and for each rule how often it is right on good and on bad texts."""

    share: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """The probability that a text with these votes is good."""
        odds = F.lit(log(self.share / (1 - self.share)))
        for vote, a, b in zip(votes, self.good, self.bad, strict=True):
            odds = odds + F.when(vote == 1, log(a / (1 - b))).when(vote == 0, log((1 - a) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def _smoothed(hits: float | None, of: float | None, start: float) -> float:
    # a few imagined votes keep a rule with hardly any votes where it started
    return ((hits or 0.0) + 4 * start) / ((of or 0.0) + 4)


def _accuracies(row, rules: int) -> Accuracies:
    good, bad = [], []
    for i in range(rules):
        a = min(HIGHEST, max(LEAST_GOOD, _smoothed(row[f"good_hit_{i}"], row[f"good_of_{i}"], START_GOOD)))
        b = _smoothed(row[f"bad_hit_{i}"], row[f"bad_of_{i}"], START_BAD)
        good.append(a)
        bad.append(min(HIGHEST, max(1 - a + LEAST_LIFT, b)))
    return Accuracies(min(0.99, max(0.5, row["good"] / row["all"])), tuple(good), tuple(bad))


def estimate(patterns: DataFrame, names: list[str], steps: int = STEPS) -> Accuracies:
    """Expectation-maximisation over vote patterns with a count ``n``; an empty table leaves the starting values."""
    now = Accuracies(START_SHARE, (START_GOOD,) * len(names), (START_BAD,) * len(names))
    votes = [F.col(name) for name in names]
    for _ in range(steps):
        good = F.col("n") * F.col("p")
        bad = F.col("n") * (1 - F.col("p"))
        sums = [F.sum("n").alias("all"), F.sum(good).alias("good")]
        for i, vote in enumerate(votes):
            cast = vote.isNotNull()
            sums += [
                F.sum(F.when(cast, good)).alias(f"good_of_{i}"), F.sum(F.when(vote == 1, good)).alias(f"good_hit_{i}"),
                F.sum(F.when(cast, bad)).alias(f"bad_of_{i}"), F.sum(F.when(vote == 0, bad)).alias(f"bad_hit_{i}")]
        row = patterns.withColumn("p", now.posterior(votes)).agg(*sums).first()
        if not row["all"]:
            return now
        found = _accuracies(row, len(names))
        moved = max(abs(x - y) for x, y in zip(
            (*found.good, *found.bad, found.share), (*now.good, *now.bad, now.share), strict=True))
        now = found
        if moved < 1e-4:
            break
    return now


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: id, measures, ``base_failed``, ``quality`` (probability) and ``kept``.

    ``base_failed`` is less than 20 words, or more than 30 % of the words in repeated runs; such a text is not kept. Null
    text counts as the empty text. Ids are passed on, null or repeated. Other columns are not read. Runs jobs when called:
    the measures are written once, to the shared folder, and read for the estimation and for the result.
    """
    names = [f"vote_{rule.name}" for rule in rules]
    measured = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    voted = stored(measured.withColumn("base_failed", failed).withColumns(
        {name: rule.vote() for name, rule in zip(names, rules, strict=True)}), "votes")
    # texts that fail anyway would make their own fault the one that the rules learn to tell
    patterns = stored(voted.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")), "patterns")
    found = estimate(patterns, names)
    quality = found.posterior([F.col(name) for name in names])
    return voted.withColumn("quality", quality).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*names)

