"""Text columns: hidden characters, keys, shingles, dates, money, markup.

Everything here is a ``Column -> Column`` expression that stays in the JVM, with
two exceptions that Spark has no expression for: the full HTML entity table and
Unicode case folding with composition. Those are Arrow-batched helpers.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.functions import fixed


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Lambdas re-evaluate outer expressions for every element, so anything costly
    is bound to a lambda variable first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: Column) -> Column:
    """Null text counts as empty text."""
    return F.coalesce(col, F.lit(""))


# --- hidden characters and look-alikes --------------------------------------

_INVISIBLE = f"[{fixed.INVISIBLE_CLASS}]"
_TAMPER = f"(?U)[{fixed.BIDI_CLASS}]|\\w[{fixed.ZERO_WIDTH_CLASS}]\\w"


def clean_invisible(col: Column) -> Column:
    return F.regexp_replace(text_or_empty(col), _INVISIBLE, "")


def invisible_count(col: Column) -> Column:
    return F.length(text_or_empty(col)) - F.length(clean_invisible(col))


def tampering(col: Column) -> Column:
    # Nearly all text has no such character: one cheap look settles it.
    value = text_or_empty(col)
    return value.rlike(_INVISIBLE) & value.rlike(_TAMPER)


def lookalikes(col: Column) -> Column:
    """Distinct sorted words of the cleaned text that mix Latin with Greek or Cyrillic."""
    words = F.regexp_extract_all(clean_invisible(col), F.lit(r"(?U)\w+"), F.lit(0))
    mixed = F.filter(
        words,
        lambda w: w.rlike(f"[{fixed.LATIN_CLASS}]") & w.rlike(f"[{fixed.LOOKALIKE_CLASS}]"),
    )
    # Most text has no Greek or Cyrillic letter at all: skip the word split then.
    return F.when(
        text_or_empty(col).rlike(f"[{fixed.LOOKALIKE_CLASS}]"), F.array_sort(F.array_distinct(mixed))
    ).otherwise(F.array().cast("array<string>"))


# --- keys ---------------------------------------------------------------------


@lru_cache(maxsize=1)
def _decompositions() -> dict[str, str]:
    """ASCII letters left over when a non-ASCII character is decomposed."""
    table = {}
    for point in range(0x80, 0x110000):
        char = chr(point)
        if char in fixed.LETTER_FOLDS:
            table[char] = fixed.LETTER_FOLDS[char]
            continue
        kept = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if kept:
            table[char] = kept
    return table


def _class_of(chars) -> str:
    """A regex character class, neighbouring code points merged into ranges."""
    points = sorted(ord(c) for c in chars)
    ranges: list[list[int]] = []
    for point in points:
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)


# ASCII plus the Latin letters of most European text: nothing in here expands
# to several letters except the folds applied to every row.
_PLAIN_LETTERS = r"\x00-\x7FÀ-ı"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str, str]:
    """(single letters, what they become, rare class, rare lookup) as plain text."""
    table = _decompositions()
    single = {c: k for c, k in table.items() if len(k) == 1}
    rare = {c: k for c, k in table.items() if len(k) > 1 and c not in fixed.LETTER_FOLDS}
    listed = "\x01".join(f"{c}\x02{k}" for c, k in rare.items())
    return "".join(single), "".join(single.values()), _class_of(rare), listed


def fold_ascii(col: Column) -> Column:
    """Accents folded away, every character without an ASCII form dropped."""
    single, becomes, rare_class, listed = _folding()
    # The rare multi-letter characters (ligatures, fractions, unit signs) go
    # through a lookup that only rows containing one of them evaluate. It is one
    # literal, folded into a constant map when the query is planned.
    lookup = F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))
    has_rare = F.regexp_replace(col, f"[{_PLAIN_LETTERS}]+", "").rlike(f"[{rare_class}]")
    pieces = F.regexp_extract_all(col, F.lit(f"[{rare_class}]|[^{rare_class}]+"), F.lit(0))
    expanded = F.when(
        col.rlike(f"[^{_PLAIN_LETTERS}]") & has_rare,
        F.array_join(
            F.transform(pieces, lambda p: F.coalesce(F.try_element_at(lookup, p), p)), ""
        ),
    ).otherwise(col)
    for char, kept in fixed.LETTER_FOLDS.items():
        if len(kept) > 1:
            expanded = F.replace(expanded, F.lit(char), F.lit(kept))
    folded = F.regexp_replace(F.translate(expanded, single, becomes), r"[^\x00-\x7F]", "")
    return F.when(col.rlike(r"[^\x00-\x7F]"), folded).otherwise(col)


def normalize_text(col: Column) -> Column:
    """Lower-case ASCII letters and digits, one space between words."""
    folded = F.lower(fold_ascii(text_or_empty(col)))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def title_key(col: Column) -> Column:
    return normalize_text(F.regexp_replace(text_or_empty(col), r"[\(\[][^\)\]]*[\)\]]", " "))


def words_of(col: Column) -> Column:
    """Words of an already normalised column, without the empty word of ''."""
    return F.filter(F.split(col, " "), lambda w: w != "")


def company_key(col: Column) -> Column:
    noise = F.array(*[F.lit(w) for w in fixed.COMPANY_KEY_NOISE])
    kept = F.filter(words_of(normalize_text(col)), lambda w: ~F.array_contains(noise, w))
    return F.array_join(kept, " ")


def content_key(title: Column, company: Column) -> Column:
    t, c = title_key(title), company_key(company)
    return F.when((t != "") & (c != ""), F.concat_ws("|", t, c)).otherwise(F.lit(""))


def loose_part(col: Column) -> Column:
    plain = F.regexp_replace(F.lower(text_or_empty(col)), r"(?U)[^\w\s]", "")
    return F.btrim(F.regexp_replace(plain, r"(?U)\s+", " "))


def loose_key(title: Column, company: Column) -> Column:
    """The in-run key: keeps accents, bracket contents and legal suffixes."""
    t, c = loose_part(title), loose_part(company)
    return F.when((t != "") & (c != ""), F.concat_ws("|", t, c)).otherwise(F.lit(""))


def title_words(col: Column) -> Column:
    return F.array_distinct(words_of(title_key(col)))


def description_head(col: Column) -> Column:
    """Normalised text up to the head length, '' when too short to compare."""
    return let(
        words_of(normalize_text(col)),
        lambda words: F.when(
            F.size(words) >= fixed.HEAD_MIN_WORDS,
            F.array_join(F.slice(words, 1, fixed.HEAD_WORDS), " "),
        ).otherwise(F.lit("")),
    )


def _runs(words: Column, size: int) -> list[Column]:
    """The word list shifted by 0, 1, ... so that zipping it gives the runs."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    return [F.slice(words, i + 1, n) for i in range(size)]


def _zipped(words: Column, size: int, make) -> Column:
    """Element-wise ``make(run)`` over the runs of ``size`` words, in one pass."""
    names = [f"w{i}" for i in range(size)]
    zipped = F.arrays_zip(*[r.alias(n) for r, n in zip(_runs(words, size), names)])
    return F.transform(zipped, lambda z: make([z.getField(n) for n in names]))


def shingles(head: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` consecutive words."""
    return let(
        words_of(head),
        lambda words: F.when(
            F.size(words) >= size,
            F.array_distinct(_zipped(words, size, lambda run: F.concat_ws(" ", *run))),
        ).otherwise(F.array().cast("array<string>")),
    )


def shingle_hashes(head: Column, size: int = 3) -> Column:
    """The same runs as 64-bit hashes: what the similarity joins shuffle."""
    return let(
        words_of(head),
        lambda words: F.when(
            F.size(words) >= size,
            F.array_distinct(_zipped(words, size, lambda run: F.xxhash64(*run))),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets held as arrays without repeats."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0),
        shared.cast("double") / (F.size(a) + F.size(b) - shared),
    ).otherwise(F.lit(0.0))


def job_id(url: Column) -> Column:
    return F.substring(F.sha2(text_or_empty(url), 256), 1, 16)


def slug(day: Column, company: Column, title: Column) -> Column:
    parts = F.concat_ws(
        "-",
        day.cast("string"),
        F.coalesce(F.nullif(company, F.lit("")), F.lit("unknown")),
        F.coalesce(F.nullif(title, F.lit("")), F.lit("role")),
    )
    plain = F.btrim(F.regexp_replace(F.lower(parts), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(plain, 1, 120), F.lit("")), F.lit("posting"))


def single_spaced(col: Column) -> Column:
    """One space for each run of blanks, at the ends too."""
    return F.regexp_replace(text_or_empty(col), r"(?U)\s+", " ")


def one_line(col: Column) -> Column:
    return F.btrim(single_spaced(col))


# Characters that stand for themselves in composed text, next to each other too, and whose lower case is their case
# folding (sharp s apart), beside ASCII: Latin-1, Latin Extended-A and what prose has of punctuation.
_FOLDS_AS_LOWER = r"\xA0-\xB4\xB6-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}\x{2122}\x{FFFD}"


@F.pandas_udf(T.StringType())
def _compose_and_fold(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFC", s).casefold(), na_action="ignore")


def folded(col: Column, lowered: Column | None = None) -> Column:
    """Composed and case-folded. Only text that needs Unicode tables Spark lacks leaves the JVM.

    ``lowered`` is the text in lower case, if at hand.
    """
    value = text_or_empty(col)
    # two ranges decide nearly every character; the list is asked about the others only
    other = value.rlike(rf"[^\x00-\x7F](?:(?<![\xA0-\xFF])|(?<=\xB5))(?<![{_FOLDS_AS_LOWER}])")
    low = F.lower(value) if lowered is None else text_or_empty(lowered)
    plain = F.replace(low, F.lit("ß"), F.lit("ss"))
    return F.coalesce(_compose_and_fold(F.when(other, value)), plain)


def flat(col: Column) -> Column:
    """:func:`folded`, with one space between words."""
    return one_line(folded(col))


# --- dates, money, flags --------------------------------------------------------


def iso_date_prefix(col: Column) -> Column:
    value = text_or_empty(col)
    return F.coalesce(F.nullif(F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), value)


_RFC2822 = r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4}) \d{1,2}:\d{2}(?::\d{2})?(?: \S+)?\s*$"


def rfc2822_date(col: Column) -> Column:
    """The date as written in the message, in the message's own offset."""
    value = text_or_empty(col)
    written = F.nullif(F.regexp_extract(value, _RFC2822, 1), F.lit(""))
    parsed = F.to_date(F.try_to_timestamp(written, F.lit("d MMM yyyy")))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), value)


def _thousands(col: Column) -> Column:
    return F.format_number(col.cast("double").cast("long"), 0)


def format_salary(
    minimum: Column, maximum: Column, currency: Column, suffix: Column, text: Column
) -> Column:
    """Text wins. Otherwise ``CUR 1,000-2,000<suffix>`` or ``CUR 1,000+<suffix>``."""
    low, high = minimum.cast("double"), maximum.cast("double")
    written = F.btrim(text_or_empty(text))
    cur = F.btrim(text_or_empty(currency))
    both = F.concat(cur, F.lit(" "), _thousands(low), F.lit("-"), _thousands(high), suffix)
    only = F.concat(cur, F.lit(" "), _thousands(low), F.lit("+"), suffix)
    return (
        F.when(written != "", written)
        .when((F.coalesce(low, F.lit(0.0)) != 0) & (F.coalesce(high, F.lit(0.0)) != 0), F.btrim(both))
        .when(F.coalesce(low, F.lit(0.0)) != 0, F.btrim(only))
        .otherwise(F.lit(""))
    )


def pay_suffix(code: Column) -> Column:
    """``Y`` -> ``/yr`` and so on, unknown codes give nothing."""
    out = F.lit("")
    for key, shown in fixed.PAY_INTERVAL.items():
        out = F.when(code == key, F.lit(shown)).otherwise(out)
    return out


def slash_suffix(interval: Column) -> Column:
    """The second layout: `` / interval``."""
    return F.concat(F.lit(" / "), F.btrim(text_or_empty(interval)))


def detect_remote(flag: Column, text: Column) -> Column:
    lowered = F.lower(text_or_empty(text))
    return F.coalesce(flag, lowered.contains("remote") | lowered.contains("hjemmearbejde"))


# --- markup -----------------------------------------------------------------------


#: The entities that nearly all pages have. The ampersand comes last, so that nothing is decoded twice.
_COMMON_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\xa0", "&amp;": "&"}
_OTHER_ENTITY = r"&(?!(?:lt|gt|quot|#39|nbsp|amp);|[ \t\n\f<&;]|\z)"


# What the library takes for a reference; each is decoded by itself.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda refs: [html.unescape(r) for r in refs], na_action="ignore")


def html_unescape(col: Column) -> Column:
    """The full HTML5 entity table, which Spark has no expression for.

    Text with the common entities only stays in the JVM; of other text its distinct references leave it, not the text.
    """
    plain = col
    for entity, char in _COMMON_ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    refs = F.when(
        col.rlike(_OTHER_ENTITY), F.array_distinct(F.regexp_extract_all(col, F.lit(_REFERENCE), F.lit(0))))
    pieces = F.regexp_extract_all(col, F.lit(f"{_REFERENCE}|[^&]+|&"), F.lit(0))
    decoded = let(F.map_from_arrays(refs, _unescape(refs)), lambda known: F.array_join(
        F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), ""))
    return F.when(refs.isNotNull(), decoded).otherwise(plain)


_BREAK = r"(?i)<br\s*/?>|</p>|</li>|</h\d>"
# Line ends that text is split at: \r\n, \n, \r, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _tidy_lines(col: Column) -> Column:
    lines = F.transform(
        F.split(col, LINE_END),
        lambda line: F.regexp_replace(
            F.regexp_replace(line, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""
        ),
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def html_to_text(col: Column) -> Column:
    """One line per block, tags dropped, entities decoded after the tags are gone."""
    broken = F.regexp_replace(text_or_empty(col), _BREAK, "\n")
    return _tidy_lines(html_unescape(F.regexp_replace(broken, "<[^>]+>", " ")))


def page_text(col: Column) -> Column:
    """As :func:`html_to_text`, without script, style and noscript blocks."""
    visible = F.regexp_replace(
        text_or_empty(col), r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " "
    )
    return html_to_text(visible)


def strip_tags_inline(col: Column) -> Column:
    value = text_or_empty(col)
    stripped = one_line(F.regexp_replace(value, "<[^>]+>", " "))
    return F.when(value.contains("<") & value.contains(">"), stripped).otherwise(value)


def cut_after(col: Column, marker: str) -> Column:
    return F.btrim(F.substring_index(text_or_empty(col), marker, 1))


# --- pattern lists --------------------------------------------------------------------


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def matches_any(col: Column, patterns, whole_word: bool = False) -> Column:
    """Does any pattern occur in the lower-cased text?

    As plain substrings (spaces in a pattern count), or as whole words.
    """
    wanted = [p for p in patterns if p.strip()] if whole_word else [p for p in patterns if p]
    if not wanted:
        return F.lit(False)
    if whole_word:
        body = "|".join(_quoted(p.strip()) for p in wanted)
        return col.rlike(f"(?U)(?<!\\w)(?:{body})(?!\\w)")
    return F.exists(F.array(*[F.lit(p) for p in wanted]), lambda p: F.contains(col, p))


def contains_any(col: Column, words) -> Column:
    """Any of a short fixed list, as one chain of ``contains``."""
    out = F.lit(False)
    for word in words:
        out = out | col.contains(word)
    return out
