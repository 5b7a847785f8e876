"""Would a machine read this page as intended? Checks over extracted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx


def _result(name: str, verdict: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), verdict.alias("verdict"), detail.alias("detail"))


def _shown(col: Column) -> Column:
    return col.cast("string")


def page_stats(pages: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, chars, pages): what the first two checks need, from partial sums."""
    stripped = F.regexp_replace(tx.text_or_empty(F.col(text)), r"(?U)^\s+|\s+$", "")
    return pages.groupBy(doc).agg(
        F.sum(F.length(stripped)).alias("chars"), F.count("*").alias("pages")
    )


def check_text_layer(chars: Column, floor: int = 800) -> Column:
    return _result(
        "text layer",
        F.when(chars >= floor, "pass").otherwise("fail"),
        F.when(chars >= floor, F.concat(_shown(chars), F.lit(" characters extracted"))).otherwise(
            F.concat(F.lit("only "), _shown(chars), F.lit(f" characters extracted, expected at least {floor}"))
        ),
    )


def check_pages(pages: Column, limit: int = 2) -> Column:
    return _result(
        "pages",
        F.when(pages <= limit, "pass").otherwise("fail"),
        F.when(pages <= limit, F.concat(_shown(pages), F.lit(" page(s)"))).otherwise(
            F.concat(_shown(pages), F.lit(f" pages, limit is {limit}"))
        ),
    )


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\D+", "")


def _phone_found(wanted: Column, digits: Column) -> Column:
    return (wanted == "") | digits.contains(wanted) | (
        (F.length(wanted) > 8) & digits.contains(F.right(wanted, F.lit(8)))
    )


def _held(body: Column, wanted: Column) -> Column:
    """Does the text, blanks made one space, contain ``wanted``? Only text with its last word has its blanks looked at."""
    last = F.contains(body, F.substring_index(wanted, " ", -1))
    return last & (~wanted.contains(" ") | F.contains(tx.one_line(body), wanted))


def check_contact(text: Column, name: Column, email: Column, phone: Column, body: Column | None = None) -> Column:
    """Null means not expected. Without anything expected the check warns. ``body`` is the text folded, if at hand."""
    # Each reading of the text is made once.
    read = F.struct(
        (tx.folded(text) if body is None else body).alias("body"), tx.flat(email).alias("email"), tx.flat(name).alias("name"),
        F.when(phone.isNotNull(), _digits(text)).alias("digits"), _digits(phone).alias("phone"),
    )

    def absent(r: Column) -> Column:
        return F.struct(
            (email.isNotNull() & ~_held(r["body"], r["email"])).alias("email"),
            (phone.isNotNull() & ~_phone_found(r["phone"], r["digits"])).alias("phone"),
            (name.isNotNull() & ~_held(r["body"], r["name"])).alias("name"),
        )

    def judge(no: Column) -> Column:
        missing = F.concat_ws(
            ", ",
            F.when(no["email"], F.concat(F.lit("email ("), email, F.lit(")"))),
            F.when(no["phone"], F.concat(F.lit("phone ("), phone, F.lit(")"))),
            F.when(no["name"], F.concat(F.lit("name ("), name, F.lit(")"))),
        )
        nothing = name.isNull() & email.isNull() & phone.isNull()
        return _result(
            "contact",
            F.when(nothing, "warn").when(missing == "", "pass").when(no["email"] | no["name"], "fail").otherwise("warn"),
            F.when(nothing, "no name, email or phone to check against")
            .when(missing == "", "name, email and phone all extract")
            .otherwise(F.concat(F.lit("missing from the text layer: "), missing)),
        )

    return tx.let(tx.let(read, absent), judge)


def check_reading_order(first_page: Column, name: Column, window: int = 300, body: Column | None = None) -> Column:
    """``body`` is the first page folded, if at hand."""
    surname = F.try_element_at(
        F.filter(F.split(tx.flat(F.coalesce(name, F.lit(""))), " "), lambda w: w != ""), F.lit(-1)
    )

    def place(r: Column) -> Column:
        # What comes before the surname, blanks made one space, is how far in it stands: nothing after it is looked at.
        before = F.ltrim(tx.single_spaced(F.call_function("substring_index", r["body"], r["surname"], F.lit(1))))
        return F.struct(
            r["surname"].alias("surname"), F.when(F.contains(r["body"], r["surname"]), F.length(before)).alias("at"))

    def judge(r: Column) -> Column:
        surname, at = r["surname"], r["at"]
        # The whole word has to lie inside the window.
        early = at + F.length(surname) <= window
        where = F.when(at.isNotNull(), F.concat(F.lit("character "), _shown(at))).otherwise("not on page 1 at all")
        return _result(
            "reading order",
            F.when(surname.isNull() | first_page.isNull(), "warn").when(early, "pass").otherwise("fail"),
            F.when(surname.isNull() | first_page.isNull(), "no name to look for")
            .when(early, F.concat(F.lit("name extracts at character "), _shown(at)))
            .otherwise(F.concat(F.lit("the name is "), where, F.lit(f", not in the first {window}"))),
        )

    page = tx.folded(first_page) if body is None else body
    return tx.let(tx.let(F.struct(page.alias("body"), surname.alias("surname")), place), judge)


def damage_count(text: Column) -> Column:
    out = F.lit(0)
    for sequence in fixed.MOJIBAKE:
        out = out + text.contains(sequence).cast("int")
    return out


def check_encoding(text: Column) -> Column:
    seen = F.struct(damage_count(text).alias("damaged"), tx.contains_any(text, fixed.LIGATURES).alias("ligatures"))

    def judge(seen: Column) -> Column:
        damaged, ligatures = seen["damaged"], seen["ligatures"]
        return _result(
            "encoding",
            F.when(damaged > 0, "fail").when(ligatures, "warn").otherwise("pass"),
            F.when(damaged > 0, F.concat(_shown(damaged), F.lit(" damaged sequence(s)")))
            .when(ligatures, "ligature code points in the text layer")
            .otherwise("no mojibake, no ligature code points"),
        )

    return tx.let(seen, judge)


def check_residue(text: Column) -> Column:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.LATEX_RESIDUE), F.lit(0))))

    def judge(seen: Column) -> Column:
        clean = F.size(seen) == 0
        return _result(
            "residue",
            F.when(clean, "pass").otherwise("fail"),
            F.when(clean, "no LaTeX in the text layer").otherwise(
                F.concat(F.lit("LaTeX in the extracted text: "), F.array_join(F.slice(seen, 1, 6), ", "))
            ),
        )

    # No backslash, no residue: most texts skip the pattern.
    return tx.let(F.when(text.contains("\\"), found).otherwise(F.array().cast("array<string>")), judge)


def check_headings(text: Column, lowered: Column | None = None) -> Column:
    """``lowered`` is the text in lower case, if at hand."""

    def present(lowered: Column) -> Column:
        return F.filter(
            F.array(*[F.when(lowered.contains(w), F.lit(w)) for w in sorted(fixed.SECTION_WORDS)]),
            lambda w: w.isNotNull(),
        )

    def judge(words: Column) -> Column:
        listed = F.array_join(words, ", ")
        enough = F.size(words) >= 3
        return _result(
            "headings",
            F.when(enough, "pass").otherwise("warn"),
            F.when(enough, F.concat(F.lit("found "), listed)).otherwise(
                F.concat(F.lit("only found "), F.coalesce(F.nullif(listed, F.lit("")), F.lit("none")))
            ),
        )

    return tx.let(F.lower(text) if lowered is None else lowered, lambda low: tx.let(present(low), judge))


# A letter, then word characters and signs, without the full stops, strokes and dashes at the end: three at least.
_KEYWORD = r"(?U)[^\W\d_][\w+#./-]+[\w+#]"


def top_keywords(docs: DataFrame, doc: str, text: str, limit: int = 25) -> DataFrame:
    """(doc, rank, word, n): each document's own vocabulary, commonest first."""
    words = F.regexp_extract_all(F.lower(tx.text_or_empty(F.col(text))), F.lit(_KEYWORD), F.lit(0))
    kept = docs.select(doc, F.explode(words).alias("word")).filter(~F.col("word").isin(*fixed.KEYWORD_STOP_WORDS))
    counts = kept.groupBy(doc, "word").agg(F.count("*").alias("n")).filter("n >= 2")
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= limit).select(doc, "rank", "word", "n")


def keyword_arrays(keywords: DataFrame, doc: str) -> DataFrame:
    """:func:`top_keywords` as one ranked array per document (at most ``limit``)."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return keywords.groupBy(doc).agg(F.transform(listed, lambda k: k["word"]).alias("keywords"))


def missing_keywords(text: Column, keywords: Column, lowered: Column | None = None) -> Column:
    return tx.let(
        F.lower(text) if lowered is None else lowered, lambda low: F.filter(keywords, lambda k: ~F.contains(low, k)))


def check_keywords(text: Column, keywords: Column, floor: float = 0.6, lowered: Column | None = None) -> Column:
    """Share of the keywords the text contains; a low share warns. ``lowered`` is the text in lower case, if at hand."""
    total = F.size(keywords)

    def judge(missing: Column) -> Column:
        covered = (total - F.size(missing)).cast("double") / total
        detail = F.concat(
            _shown(F.bround(covered * 100, 0).cast("int")), F.lit("% of the posting's "), _shown(total),
            F.lit(" commonest terms are in the PDF"),
        )
        absent = F.array_join(F.slice(missing, F.lit(1), F.when(covered >= floor, 8).otherwise(12)), ", ")
        none = keywords.isNull() | (total == 0)
        return _result(
            "keywords",
            F.when(none, "warn").when(covered >= floor, "pass").otherwise("warn"),
            F.when(none, "no job description given, or nothing to extract from it").otherwise(
                F.concat(detail, F.when(F.size(missing) > 0, F.concat(F.lit(". Absent: "), absent)).otherwise(""))
            ),
        )

    return tx.let(missing_keywords(text, keywords, lowered), judge)


def run_checks(docs: DataFrame, doc: str) -> DataFrame:
    """All eight checks per document, long form.

    ``docs`` has the text, its first page, ``chars``, ``pages``, the expected
    ``name``, ``email``, ``phone`` (null = not expected) and ``keywords``.
    """
    # What several checks read is made once for all of them; a first page that is the whole text is not read again.
    text, page = F.col("text"), F.col("first_page")
    other = F.when(~page.eqNullSafe(text), page)
    docs = docs.withColumn("_lowered", F.lower(text)).withColumns({
        "_body": tx.folded(text, F.col("_lowered")), "_page": F.when(other.isNotNull(), tx.folded(other)),
    })
    checks = F.array(
        check_text_layer(F.col("chars")),
        check_pages(F.col("pages")),
        check_contact(text, F.col("name"), F.col("email"), F.col("phone"), F.col("_body")),
        check_reading_order(page, F.col("name"), body=F.coalesce("_page", "_body")),
        check_encoding(text),
        check_residue(text),
        check_headings(text, F.col("_lowered")),
        check_keywords(text, F.col("keywords"), lowered=F.col("_lowered")),
    )
    return docs.select(doc, F.posexplode(checks).alias("place", "c")).select(doc, "place", "c.*")


def report(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict").agg(F.count("*").alias("n"))

