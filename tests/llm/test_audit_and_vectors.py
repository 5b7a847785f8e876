"""Filter audit, hard negatives and exact search against brute force, with odd rows of every kind."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from postsift.llm import exact_search, filter_audit, hard_negatives, tiles

# ---- op11

WHITE = " \t\n\r\x0b\x0c"
TEXTS = [
    None, "", " ", None, "a", "a", "A" * 30 + " b", "x#y", "\x85\xa0 é", "SHOUT " * 120, "same " * 150, "日本語 " * 120 + "$",
    " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}" for i in range(99)),
    " ".join(f"w{i % 96}" for i in range(120)), " ".join(f"w{i % 95}" for i in range(120)),
    "\x0b".join(f"W{i}" for i in range(100)) + " |", "1 B" * 400, "B" + "b" * 9, "BB" + "b" * 9,
]


def brute_audit(rows, good, toxic):
    """rows of (id, text, part): the whole result as a dictionary."""
    faults = []
    for i, text, part in rows:
        t, words = text or "", (text or "").translate(str.maketrans(WHITE, " " * 6)).split(" ")
        words = [w for w in words if w]
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        faults.append((part or "", "".join(c for c, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), copy)) if bad),
            i in good, i in toxic))
    out = {}
    for part in {f[0] for f in faults}:
        mine = [f for f in faults if f[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(c in f[1] for f in mine) - len(gone), sum(f[1] == c for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def docs_of(spark, rows):
    """Documents with columns named like those used inside."""
    return spark.createDataFrame(
        [(i, t, p, "d", 5, True) for i, t, p in rows],
        "doc_id long, text string, lang string, digest string, n int, copy boolean")


def audited(spark, rows, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "doc_id AS id", "'x' AS part")
    got = filter_audit.audit_texts(docs_of(spark, rows), labels).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): [
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}


def test_audit_of_odd_texts(spark):
    rng = random.Random(3)
    rows = [(i, t, rng.choice([None, "", "en", "de"])) for i, t in enumerate(TEXTS * 2)]
    rows += [(None, TEXTS[12], "en"), (None, None, None), (40, TEXTS[40 % len(TEXTS)], "fr"), (12, TEXTS[12], "en"), (5, "other", "fr")]
    rng.shuffle(rows)
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    good, toxic = {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, t in marks if t == 1 and i is not None}
    assert audited(spark, rows, marks) == brute_audit(rows, good, toxic)
    assert audited(spark, rows, []) == brute_audit(rows, set(), set())


def test_audit_of_no_documents(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_audit_folds_a_group_of_copies(spark):
    rows = [(i, TEXTS[12], "en") for i in range(2000)]
    got = audited(spark, rows, [])
    assert got["en", "EABCD", 1] == [1, 1999, 0, 1999, 0, 0, 120 * 1999]


def test_long_text_is_cut_at_white_space(spark, monkeypatch):
    raw = b"ab cd\tab " * 50 + "é\x85x ".encode() + b"y" * 100
    words = raw.split()
    for size in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(filter_audit, "SLICE_BYTES", size)
        assert filter_audit._words(raw) == (len(words), len(set(words)))


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_removal_steps(k):
    orders, steps = filter_audit.removal_steps(k)
    for m in range(1 << k):
        for o, order in enumerate(orders):
            assert steps[m, o] == next((s for s, f in enumerate(order) if m >> f & 1), k)


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), ("q", False, None)], "g string, a boolean, b boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in filter_audit.audit(rows, {"X": "a", "Y": "b"}, "g").collect()}
    assert got["p", "XY", 2] == (0, 0, 1) and got["p", "YX", 1] == (1, 1, 0) and got["q", "YX", 2] == (1, 0, 0)
    with pytest.raises(ValueError, match="between 1 and 8"):
        filter_audit.audit(rows, {}, "g")


# ---- op12, op13


def whole(vector):
    return [math.floor(256 * float(x)) for x in vector]


def usable(rows, labelled):
    return [
        (i, label, whole(v)) for i, label, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        and (label is not None or not labelled)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_search(rows, queries, k):
    out = set()
    for q, _, v in usable(queries, False):
        scored = sorted((-dot(v, w), i) for i, _, w in usable(rows, False) if i != q)
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def brute_mine(rows, anchors, k=5):
    out = set()
    for a, label, v in usable(anchors, True):
        scored = sorted((-dot(v, w), i, other) for i, other, w in usable(rows, True) if i != a)
        for p, pos, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out |= {(a, pos, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fits[:k], 1)}
    return out


def embeddings(spark, rows, kind="float"):
    frame = spark.createDataFrame([(i, label, v) for i, label, v in rows], f"vec_id long, label int, embedding array<{kind}>")
    return frame.selectExpr("*", "'x' AS id", "1 AS tile", "true AS wide", "2.5D AS score", "embedding AS items")


def sample(rng, n, dim=8, spread=2.0):
    rows = [(i, rng.randrange(3), [rng.randrange(-4, 5) * spread / 4 + rng.random() / 8 for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rng.randrange(3), rows[i % 7][2]) for i in range(20)]           # ties
    rows += [
        (None, 1, [1.0] * dim), (n + 30, None, [1.0] * dim), (n + 31, 1, None), (n + 32, 1, [1.0] * (dim - 1) + [None]),
        (n + 33, 2, [float("nan")] * dim), (n + 34, 0, [float("inf")] + [0.0] * (dim - 1)), (n + 35, 0, []), (n + 36, 1, [0.5]),
        (n + 37, 1, [0.0] * dim)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_search_and_negatives(spark, seed):
    rng = random.Random(seed)
    rows = sample(rng, 150)
    asked = [r for r in rows if r[0] is not None and r[0] % 9 == 0]
    df, queries = embeddings(spark, rows), embeddings(spark, asked)
    small = {"tile_rows": 23, "block_queries": 5, "least": 1}
    for grid in ({}, small):
        got = exact_search.search(df, queries, 5, **grid).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(brute_search(rows, asked, 5))
        for bits in (52, 0):
            got = hard_negatives.mine(df, queries, carrier_bits=bits, **grid).collect()
            found = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got]
            assert sorted(found) == sorted(brute_mine(rows, asked))


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, i % 3, [rng.uniform(-1, 1) * 2.0 ** rng.randrange(30, 48) for _ in range(4)]) for i in range(60)]
    rows = [(i, n, [x / 2.0 ** 27 for x in v]) for i, n, v in rows]
    asked = rows[::10]
    df, queries = embeddings(spark, rows, "double"), embeddings(spark, asked, "double")
    got = exact_search.search(df, queries).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_search(rows, asked, 5)
    got = hard_negatives.mine(df, queries).collect()
    assert {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got} == brute_mine(rows, asked)


def test_scores_beyond_64_bits_become_the_nearest(spark):
    df = embeddings(spark, [(0, 0, [1e30]), (1, 0, [1e30]), (2, 0, [-1e30]), (3, 0, [1e308])], "double")
    got = {(r.vec_id, r.score) for r in exact_search.search(df, df.where("vec_id = 0")).collect()}
    assert got == {(1, (1 << 63) - 1), (2, 1 - (1 << 63))}


def test_empty_tables_and_repeated_queries(spark):
    rows = [(i, i % 2, [i / 8, 1.0]) for i in range(12)]
    df, none = embeddings(spark, rows), embeddings(spark, [])
    assert exact_search.search(none, df).count() == exact_search.search(df, none).count() == 0
    assert hard_negatives.mine(none, df).count() == hard_negatives.mine(df, none).count() == 0
    twice = exact_search.search(df, df.where("vec_id = 3").unionByName(df.where("vec_id = 3"))).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in twice} == brute_search(rows, [rows[3]], 5) and len(twice) == 5


def test_merging_goes_level_by_level(spark):
    lists = spark.createDataFrame([(t, 1, t * 3 % 101, t * 3 % 101) for t in range(100)], "tile int, query_id long, id long, score long")
    best = tiles.best_of_tiles(lists, 100, ["query_id"], 3, [lists["score"].desc(), lists["id"]], fan_in=4)
    assert sorted((r["rank"], r.score) for r in best.collect()) == [(1, 100), (2, 99), (3, 97)]
    assert best._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number") == 4


@pytest.mark.parametrize("bits", [52, 40, 0])
def test_packed_products(bits):
    rng = np.random.default_rng(bits)
    rows = rng.integers(-300, 200, (101, 16)).astype(float)
    anchors = rng.integers(-300, 200, (7, 16)).astype(float)
    packed = hard_negatives.Packed(rows, hard_negatives.reach_of(anchors), bits)
    assert (packed.fields >= 2) == (bits == 52) and (packed.products(anchors) == (anchors @ rows.T)).all()
