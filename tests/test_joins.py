"""Term scans, capped searches, outcome matches and hostile pages against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from postsift.operators import calibration, sensitive, similarity
from postsift.session import cut_lineage
from postsift.sources import feeds, markup


def brute_scan(lines, terms):
    return {(p, n, t.lower().find(term) + 1, e) for p, n, t in lines if t for e, term in terms if term and term in t.lower()}


@pytest.mark.parametrize("seed,bits", [(1, 27), (2, 4), (3, 12)])
def test_scan_terms_is_a_plain_search(spark, seed, bits):
    rng = random.Random(seed)
    letters = "abAB é日🙂-"
    word = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    lines = [(i % 9, i, word(0, 60)) for i in range(120)] + [(1, 900, None), (1, 901, ""), (2, 902, "ab" * 3000)]
    terms = [(e, word(1, 12).lower()) for e in range(60)] + [(70, ""), (71, None), (72, "a"), (73, "a"), (74, "🙂"), (75, "abab" * 9)]
    terms += [(80 + i, lines[i][2][3:20].lower()) for i in range(20)]
    frames = (spark.createDataFrame(lines, "path int, line int, content string"), spark.createDataFrame(terms, "entry long, term string"))
    got = sensitive.scan_terms(*frames, table_bits=bits).collect()
    want = brute_scan(lines, terms)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_a_long_list_is_neither_collected_nor_read_per_block(spark):
    lines = spark.createDataFrame([(1, i, f"line {i} holds needle{i * 997 % 5000}z") for i in range(200)], "path int, line int, content string")
    terms = spark.range(20_000).select(F.col("id").alias("entry"), F.format_string("needle%dz", "id").alias("term"))
    hits = sensitive.scan_terms(lines, terms)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    assert {(r.line, r.entry) for r in hits.collect()} == {(i, i * 997 % 5000) for i in range(200)}


def brute_caps(rows, searches):
    taken, out = set(), set()
    for term, want in searches:
        for pos, url, t in sorted(rows):
            if t == term and url and want and url not in taken:
                taken.add(url)
                out.add(pos)
                want -= 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_caps_of_searches(spark, seed):
    rng = random.Random(seed)
    searches = [("a", 5), ("b", 4), ("c", 0), ("d", 7), ("e", 3)]
    rows = [(i, rng.choice(["", *(f"u{k}" for k in range(12))]), rng.choice("abcdex")) for i in range(80)]
    frame = spark.createDataFrame(rows, "pos long, url string, search_term string").repartition(3)
    assert {r.pos for r in feeds.cap_per_search(frame, searches).collect()} == brute_caps(rows, searches)


def test_caps_that_hang_on_each_other(spark):
    # each term wants the url that the one before it takes: right only after a round for each term
    terms = "abcdef"
    rows = [(i * 10 + j, f"u{i + j}", t) for i, t in enumerate(terms) for j in range(3)]
    frame = spark.createDataFrame(rows, "pos long, url string, search_term string")
    searches = [(t, 1) for t in terms]
    assert {r.pos for r in feeds.cap_per_search(frame, searches).collect()} == brute_caps(rows, searches)
    assert feeds.cap_per_search(frame.limit(0), searches).count() == 0


def test_a_hostile_page_is_passed_over(spark):
    block = '<script type="application/ld+json">%s</script>'
    good = block % '{"@type": "JobPosting", "title": "Baker"}'
    bad = block % ("[" * 200_000 + '"JobPosting"' + "]" * 200_000)
    pages = spark.createDataFrame([(1, bad + good), (2, bad), (3, good)], "id int, html string")
    got = {r.id: r.ld_title for r in markup.extract_ld_posting(pages).collect()}
    assert got == {1: "Baker", 2: None, 3: "Baker"}


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_most_similar_sets(spark, monkeypatch, threshold):
    rng = random.Random(4)
    bag = [tuple(sorted(rng.sample(range(14), rng.randint(1, 9)))) for _ in range(40)]
    side = lambda n: list({(rng.choice("ab"), t) for t in (rng.choice(bag) if rng.random() < 0.4 else tuple(sorted(rng.sample(range(14), rng.randint(1, 9)))) for _ in range(n))})
    left, right = side(70), side(60)
    number = {t: i for i, t in enumerate(sorted({t for _, t in left + right}))}
    frames = [spark.createDataFrame([(b, number[t], list(t)) for b, t in x], "block string, id long, tokens array<long>") for x in (left, right)]
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = set()
    for b, t in left:
        scored = [(jac(t, u), number[u]) for c, u in right if c == b]
        top = max([s for s, _ in scored], default=0)
        want |= {(b, number[t], u, round(s, 9)) for s, u in scored if s == top and s >= threshold}
    verified = []
    plain = similarity.verify
    monkeypatch.setattr(similarity, "verify", lambda pairs, *rest: (verified.append(pairs), plain(pairs, *rest))[1])
    got = similarity.most_similar_in_block(*frames, threshold, cut_lineage)
    assert {(r.block, r.id_a, r.id_b, round(r.similarity, 9)) for r in got.collect()} == want
    equal = {(b, t) for b, t in left} & {(b, t) for b, t in right}
    assert equal and not {number[t] for _, t in equal} & {r.id_a for v in verified for r in v.collect()} - {number[t] for b, t in left if (b, t) not in equal}


def test_best_in_block_is_exact_and_does_not_pair_sets_that_share_words(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(9)]
    draw = lambda most: sorted(rng.sample(words, rng.randint(0, most)))
    left = {(b, " ".join(t)): t for b in ("x", "word y") for t in (draw(9) for _ in range(60))}
    right = {(b, " ".join(t)): t for b in ("x", "word y", "z") for t in (draw(9) for _ in range(80))}
    best = {k: rng.randint(0, 20) for k in right}
    frames = (
        spark.createDataFrame([(b, i, t) for (b, i), t in left.items()], "block string, id string, tokens array<string>"),
        spark.createDataFrame([(b, i, t, best[b, i]) for (b, i), t in right.items()], "block string, id string, tokens array<string>, best int"),
    )
    floor = {"x": 0.9, "word y": 0.5}
    wanted = {}
    for (b, i), t in left.items():
        scored = [(-len({*t} & {*o}) / len({*t} | {*o}), best[c, j]) for (c, j), o in right.items() if c == b and t and o]
        scored = [x for x in scored if -x[0] >= floor[b]]
        if scored:
            wanted[b, i] = (-min(scored)[0], min(scored)[1])
    threshold = F.when(F.col("block").startswith("word "), 0.5).otherwise(0.9)
    got = similarity.best_in_block(*frames, threshold, cut_lineage).collect()
    assert {(r.block, r.id): (r.similarity, r.best) for r in got} == wanted and len(got) == len(wanted)

    # titles that all share a word: no pairs of titles are listed
    def refuse(*args):
        raise AssertionError("pairs were listed")

    monkeypatch.setattr(similarity, "most_similar_in_block", refuse)
    titles = lambda name, n: [(f"{name} {i}", "word a", f"engineer {name} of {i}") for i in range(n)]
    outcomes = spark.createDataFrame([(i, t, "Acme") for i, _, t in titles("sent", 30)], "outcome_id string, title string, company string")
    scored = spark.createDataFrame(
        [(i, t, "Acme", 50.0, "2024-01-01") for i, _, t in titles("seen", 30)], "job_id string, title string, company string, score double, first_seen string")
    assert calibration.match_outcomes(outcomes, scored).count() == 30
