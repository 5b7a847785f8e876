import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.operators import hygiene


def one(spark, fn, *values):
    cols = [F.lit(v).cast("string") for v in values]
    return spark.range(1).select(fn(*cols).alias("x")).first()[0]


def test_company_keys(spark):
    for name, key in {
        "Contoso Denmark A/S": "contoso", "Contoso": "contoso", "Alder Group A/S": "alder",
        "Ping & Pong A/S": "ping pong", "Østerby A/S": "osterby", "Osterby": "osterby",
    }.items():
        assert one(spark, tx.company_key, name) == key


def test_title_keys_and_text(spark):
    assert one(spark, tx.title_key, "Software Engineer, Vision (BE-ABP-2026-132-GRAP)") == "software engineer vision"
    assert one(spark, tx.normalize_text, "Senior DevOps & Dev-Productivity (v2)") == "senior devops dev productivity v2"
    assert one(spark, tx.normalize_text, None) == ""
    assert one(spark, tx.normalize_text, "Straße ½ ﬁx … foo–bar") == "strae 12 fix foobar"


def test_folding_agrees_with_python_on_every_letter(spark):
    chars = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c))[0] in "LNSPZM"]
    frame = spark.createDataFrame(pd.DataFrame({"c": chars})).repartition(4)
    got = frame.select("c", tx.normalize_text(F.concat(F.lit("a"), "c", F.lit("b"))).alias("n")).toPandas()
    fold = str.maketrans(fixed.LETTER_FOLDS)

    def expected(c):
        plain = unicodedata.normalize("NFKD", f"a{c}b".translate(fold)).encode("ascii", "ignore").decode()
        return re.sub("[^a-z0-9]+", " ", plain.lower()).strip()

    wrong = [(hex(ord(c)), n, expected(c)) for c, n in got.itertuples(index=False) if n != expected(c)]
    assert wrong == []


def test_shingles_and_heads(spark):
    words = " ".join(f"w{i}" for i in range(40))
    assert one(spark, tx.description_head, " ".join(["w"] * 29)) == ""
    assert one(spark, tx.description_head, words) == words
    assert len(one(spark, tx.shingles, words)) == 38
    assert one(spark, tx.shingles, "two words") == []
    assert len(one(spark, tx.shingle_hashes, words)) == 38
    assert one(spark, tx.shingles, "") == []


GUARD = [
    ("Pyt​hon﻿ developer", "Python developer", 2, True, []),
    ("Senior ‮euqnoh", "Senior euqnoh", 1, True, []),
    ("Ja​va", "Java", 1, True, []),
    ("Java​ developer", "Java developer", 1, False, []),
    ("Work at Аpple", "Work at Аpple", 0, False, ["Аpple"]),
    ("Mathematics: αβγ", "Mathematics: αβγ", 0, False, []),
    ("Udvikler til Odense. Æble, øl og åbent kontor.", "Udvikler til Odense. Æble, øl og åbent kontor.", 0, False, []),
]


def test_hostile_text(spark):
    rows = spark.createDataFrame([(g[0],) for g in GUARD], "t string").select(
        "t", tx.clean_invisible(F.col("t")), tx.invisible_count(F.col("t")), tx.tampering(F.col("t")), tx.lookalikes(F.col("t"))
    )
    assert {tuple(map(str, r)) for r in rows.collect()} == {tuple(map(str, g)) for g in GUARD}


def test_guard_verdicts(spark):
    rows = spark.createDataFrame([
        (1, "Dev​", "Østerby", "Python ‮abc"), (2, "Python‍ developer", "x", "Soft­ware"), (3, "a", "b", None),
    ], "id int, title string, company string, description string")
    got = {r.id: r for r in hygiene.guard(rows).collect()}
    assert got[1].guard.startswith("flagged: bidi") and got[1].guard.endswith("; 2 invisible characters removed")
    assert got[2].guard == "cleaned: 2 invisible characters removed" and got[2].description == "Software"
    assert got[3].guard == "clean" and got[3].description == ""


def test_html(spark):
    page = "<style>p{}</style><h1>A&amp;B</h1><p>x &lt;b&gt; &notanentity; &eacute;</p><ul><li>one<li>two</li></ul><SCRIPT>var</SCRIPT>"
    assert one(spark, tx.page_text, page) == "A&B\nx <b> ¬anentity; é\none two"
    assert one(spark, tx.strip_tags_inline, "a < b") == "a < b"


def test_dates_and_money(spark):
    assert one(spark, tx.rfc2822_date, "Wed, 15 Nov 2023 19:13:43 GMT") == "2023-11-15"
    assert one(spark, tx.rfc2822_date, "Wed, 15 Nov 2023 23:30:00 -0800") == "2023-11-15"
    assert one(spark, tx.rfc2822_date, "soon") == "soon"
    assert one(spark, tx.iso_date_prefix, "2026-08-20T09:00:00.000Z") == "2026-08-20"
    pay = tx.format_salary(F.lit(60000), F.lit(80000), F.lit("EUR"), tx.pay_suffix(F.lit("Y")), F.lit(None))
    assert spark.range(1).select(pay).first()[0] == "EUR 60,000-80,000/yr"


def test_slug_and_patterns(spark):
    assert one(spark, lambda d, c, t: tx.slug(d, c, t), "2026-01-02", "Østerby A/S", "Lead (x)") == "2026-01-02-sterby-a-s-lead-x"
    row = spark.range(1).select(
        tx.matches_any(F.lit("aarhusgade 12"), ["aarhus"]), tx.matches_any(F.lit("aarhusgade 12"), ["aarhus"], True),
        tx.matches_any(F.lit("aarhus, denmark"), [" aarhus "], True), tx.matches_any(F.lit("an internal"), [" intern"]),
        tx.matches_any(F.lit("c++ dev"), ["c++"], True),
    ).first()
    assert list(row) == [True, False, True, True, True]


def _refuses(message, kind="string"):
    @F.pandas_udf(kind)
    def refuse(values: pd.Series) -> pd.Series:
        if values.notna().any():
            raise ValueError(message)
        return values

    return refuse


def test_plain_text_is_folded_without_python(spark, monkeypatch):
    """Texts are long: only what Spark has no table for goes to a Python process, whose memory grows with a batch of them."""
    plain = ["Straße  ÆØÅ \xa0 É – “Œuvre” € ŽIŽKA", "", "plain ASCII", "� damaged Ã¸"]
    needed = ["été", "ΣΊΣΥΦΟΣ", "ﬁn", "İstanbul", "µ", "ŉ ſ", "가", "Ω"]
    wanted = lambda s: " ".join(unicodedata.normalize("NFC", s).casefold().split())
    rows = lambda texts: spark.createDataFrame([(s,) for s in texts], "s string")
    every = [f"a{chr(c)}b{chr(c)}" for c in range(32, 0x3000) if not 0xD800 <= c < 0xE000]
    got = rows([*plain, *needed, *every]).select("s", tx.flat(F.col("s")).alias("f")).collect()
    assert [(r.s, r.f) for r in got if r.f != wanted(r.s)] == []
    monkeypatch.setattr(tx, "_compose_and_fold", _refuses("not needed"))
    assert [r.f for r in rows(plain).select(tx.flat(F.col("s")).alias("f")).collect()] == [wanted(s) for s in plain]


def test_common_entities_are_decoded_without_python(spark, monkeypatch):
    plain = ["a &lt;b&gt; &amp;amp; &amp;lt; &quot;c&#39;&nbsp;d", "& alone", "x &", "a&<b&&;", "", "R&amp;D"]
    needed = ["&eacute;", "&lt x", "&#x41;&#65;", "AT&T", "&ampx", "&notit;", "&amp;&copy", "&\r", "&LT;", "a" * 5000 + "&copy;&#xe9 &#; &# &; &&copy;" + "b\n" * 99]
    rows = lambda texts: spark.createDataFrame([(s,) for s in texts], "s string")
    got = rows([*plain, *needed]).select("s", tx.html_unescape(F.col("s")).alias("u")).collect()
    assert [(r.s, r.u) for r in got if r.u != html.unescape(r.s)] == []
    monkeypatch.setattr(tx, "_unescape", _refuses("not needed", "array<string>"))
    assert [r.u for r in rows(plain).select(tx.html_unescape(F.col("s")).alias("u")).collect()] == [html.unescape(s) for s in plain]
