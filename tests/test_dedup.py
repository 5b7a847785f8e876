import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postsift.operators import dedup
from postsift.operators import similarity as sim
from postsift.session import ensure_checkpoint_dir
from postsift.sources import sinks
from postsift.sources.feeds import complete_seen

DAY = dt.date(2024, 1, 30)
POST = "pos bigint, title string, company string, description string, url string, site string"


def posts(spark, rows):
    full = [(i, r.get("title", ""), r.get("company", ""), r.get("description", ""), r.get("url", f"https://x.example/{i}"), r.get("site", "")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, POST).withColumns(
        {c: F.lit("") for c in ("location", "date_posted", "search_term", "salary")}
    )


def no_history(spark):
    return complete_seen(spark.createDataFrame([], "job_id string"))


def record(spark, rows, history, day=DAY, status="new", score=50.0):
    scored = rows.withColumns({"status": F.lit(status), "score": F.lit(score), "verdict_json": F.lit("")})
    return dedup.upsert_seen(scored, history, day)


def kept(df):
    return sorted(r.pos for r in df.filter("outcome = 'new'").collect())


def test_priority_beats_length(spark):
    rows = posts(spark, [
        {"title": "Solution Architect", "company": "Northwind Energy", "description": "short", "site": "linkedin"},
        {"title": "Solution Architect", "company": "Northwind Energy", "description": "a much longer one", "site": "careerjet"},
        {"title": "Platform Engineer", "company": "Halden Data", "site": "linkedin"},
        {"title": "", "company": "x"}, {"title": "", "company": "x"},
    ])
    assert sorted(r.pos for r in dedup.dedup_cross_source(rows).collect()) == [0, 2, 3, 4]
    again = dedup.dedup_cross_source(dedup.dedup_cross_source(rows))
    assert sorted(r.pos for r in again.collect()) == [0, 2, 3, 4]


LONG = " ".join(f"word{i}" for i in range(60))


def test_near_copies(spark):
    other = " ".join(f"word{i}" for i in range(25)) + " " + " ".join(f"else{i}" for i in range(40))
    rows = posts(spark, [
        {"title": "Senior Azure Architect", "company": "Contoso"},
        {"title": "Senior Azure Architect - Consulting", "company": "Contoso Denmark A/S"},
        {"title": "Data Lead", "company": "Alder", "description": LONG},
        {"title": "Something Else", "company": "Alder Group", "description": LONG + " tail"},
        {"title": "Third Thing", "company": "Alder", "description": other},
        {"title": "Elsewhere", "company": "Other", "description": LONG},
    ])
    assert kept(dedup.filter_new(rows, no_history(spark), DAY)) == [0, 1, 2, 4, 5]


def test_lookback_and_retries(spark):
    rows = posts(spark, [{"title": "Platform Engineer", "company": "Contoso", "url": "https://x.example/new"}])
    old = record(spark, posts(spark, [{"title": "Platform Engineer", "company": "Contoso A/S", "url": "https://x.example/old"}]), no_history(spark), DAY - dt.timedelta(30))
    assert kept(dedup.filter_new(rows, old, DAY)) == [0]
    near = old.withColumn("first_seen", F.lit(DAY - dt.timedelta(7)))
    assert dedup.filter_new(rows, near, DAY).first().outcome == "content"
    for attempts, fresh in ((1, True), (3, True), (4, False)):
        failed = record(spark, rows, no_history(spark), DAY, "scoring_error", 0.0).withColumn("attempts", F.lit(attempts))
        assert (kept(dedup.filter_new(rows, failed, DAY)) == [0]) is fresh


def test_upsert(spark):
    rows = posts(spark, [{"url": "https://x.example/a", "title": "first"}, {"url": "https://x.example/a", "title": "second"}, {"url": "https://x.example/b"}])
    scored = rows.withColumns({
        "status": F.when(F.col("pos") == 0, "scoring_error").otherwise("new"), "score": F.col("pos").cast("double"), "verdict_json": F.lit("{}"),
    })
    one = dedup.upsert_seen(scored, no_history(spark), DAY)
    got = {r.url[-1]: r for r in one.collect()}
    assert (got["a"].title, got["a"].status, got["a"].score, got["a"].attempts) == ("first", "new", 1.0, 2)
    assert got["b"].attempts == 1
    later = dedup.upsert_seen(scored.withColumn("score", F.lit(9.0)), one, DAY + dt.timedelta(1))
    assert {(r.url[-1], r.score, r.first_seen) for r in later.collect()} == {("a", 1.0, DAY), ("b", 2.0, DAY)}


def test_running_twice_finds_nothing_new(spark):
    rows = posts(spark, [{"title": f"Role {i} of many kinds", "company": f"c{i % 3}", "description": LONG if i % 2 else ""} for i in range(12)])
    first = dedup.filter_new(rows, no_history(spark), DAY)
    history = record(spark, first.filter("outcome = 'new'"), no_history(spark))
    assert kept(dedup.filter_new(rows, history, DAY)) == []


# --- brute force -------------------------------------------------------------------------


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(keyed):
    known, out = [], []
    for r in sorted(keyed, key=lambda r: r.pos):
        words = frozenset(r.title_key.split())
        run = r.desc_head.split()
        runs = frozenset(zip(run, run[1:], run[2:]))
        dup = False
        for t, c, w, d, key, titled in known:
            if key and key == r.content_key:
                dup = True
            if not r.company_key or c != r.company_key or not titled:
                continue
            if len(w) >= 2 and len(words) >= 2 and jac(w, words) >= 0.8:
                dup = True
            if jac(d, runs) >= 0.6:
                dup = True
        if not dup:
            out.append(r.pos)
            known.append((r.title, r.company_key, words, runs, r.content_key, bool(r.title)))
    return out


def fuzzy_batch(seed, n):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(14)]
    texts = [[rnd.choice(vocab) for _ in range(rnd.randint(30, 60))] for _ in range(5)]
    rows = []
    for _ in range(n):
        text = list(rnd.choice(texts))
        for _ in range(rnd.randint(0, 9)):
            text[rnd.randrange(len(text))] = rnd.choice(vocab)
        rows.append({
            "title": rnd.choice(["", "(x)", " ".join(rnd.sample(vocab[:7], rnd.randint(1, 6)))]) if rnd.random() < 0.5 else " ".join(rnd.sample(vocab[:7], 5)),
            "company": rnd.choice(["Contoso", "Contoso A/S", "Alder", "", "Contoso"]),
            "description": " ".join(text) if rnd.random() < 0.7 else "short",
        })
    return rows


@pytest.mark.parametrize("seed,leaders", [(1, 64), (2, 1), (3, 2), (4, 3)])
def test_greedy_matches_brute_force(spark, seed, leaders):
    rows = posts(spark, fuzzy_batch(seed, 90))
    expected = brute(dedup.with_keys(rows).collect())
    shuffled = rows.repartition(5, F.rand(seed))
    got = dedup.filter_new(shuffled, no_history(spark), DAY, leaders_per_bucket=leaders)
    assert kept(got) == expected
    assert got.count() == 90


def test_hot_group_of_copies_stays_linear(spark):
    rows = [{"title": "Same Title Here", "company": "Hot", "description": LONG} for _ in range(300)]
    rows += [{"title": f"Other {i} job", "company": "Hot", "description": f"{LONG} {i}"} for i in range(100)]
    frame = posts(spark, rows)
    assert kept(dedup.filter_new(frame, no_history(spark), DAY)) == [0]
    links = dedup.near_title_pairs(dedup.with_keys(frame))
    assert links.filter("id_a = 0").count() == 299


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 0.9])
def test_similarity_join_is_exact(spark, threshold):
    rnd = random.Random(int(threshold * 10))
    sets = [(rnd.choice("ab"), i, sorted(rnd.sample(range(25), rnd.randint(1, 18)))) for i in range(160)]
    frame = spark.createDataFrame(sets, "block string, id bigint, tokens array<bigint>")
    got = {(r.id_a, r.id_b): round(r.similarity, 9) for r in sim.similar_pairs(frame, threshold).collect()}
    want = {
        (a[1], b[1]): round(jac(set(a[2]), set(b[2])), 9) for a in sets for b in sets
        if a[1] < b[1] and a[0] == b[0] and jac(set(a[2]), set(b[2])) >= threshold
    }
    assert got == want
    left, right = frame.filter("id < 80"), frame.filter("id >= 80")
    cross = {(r.id_a, r.id_b) for r in sim.cross_pairs(left, right, threshold).collect()}
    assert cross == {(a, b) for a, b in want if a < 80 <= b}


def test_filter_new_says_something_about_every_row(spark):
    rows = posts(spark, [
        {"url": "u1", "title": "Data Architect Nordics", "company": "Contoso"}, {"url": "u1", "title": "Welder", "company": "Fabrikam"},
        {"url": "", "title": "Baker", "company": "Bread Co"}, {"url": None, "title": "Data Architect Nordics", "company": "Contoso"},
        {"url": " ", "title": "Driver", "company": "Cars Co"}, {"url": "u2", "title": "Driver", "company": "Cars Co"}])
    got = {r.pos: r.outcome for r in dedup.filter_new(rows, no_history(spark), DAY).collect()}
    assert got == {0: "new", 1: "url", 2: "new", 3: "content", 4: "new", 5: "content"}


def test_many_company_words_make_one_candidate(spark):
    sets = spark.createDataFrame([(b, 1, ["x", "y"]) for b in ("a", "b", "c")], "block string, id long, tokens array<string>")
    assert sim.cross_pairs(sets, sets, 0.5).count() == 1


def test_history_touches_only_changed_days(spark, tmp_path):
    root = str(tmp_path / "history")

    def batch(urls, status):
        rows = posts(spark, [{"url": u, "title": u} for u in urls])
        return rows.withColumns({"status": F.lit(status), "score": F.lit(1.0), "verdict_json": F.lit("")})

    def files():
        return {str(p.relative_to(root)) for p in (tmp_path / "history" / "data").rglob("*.parquet")}

    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5)]
    sinks.write_seen(batch(["a", "b"], "new"), root, days[0], "v1")
    sinks.write_seen(batch(["c"], "scoring_error"), root, days[1], "v2")
    first = files()
    sinks.write_seen(batch(["a", "c", "d"], "new"), root, days[2], "v3")
    assert first <= files(), "the version before stays readable"
    sinks.write_seen(batch(["e"], "new"), root, days[3], "v4")
    sinks.write_seen(batch(["e"], "new"), root, days[3], "v4")
    kept = [f for f in files() if "first_seen=2024-01-01" in f]
    assert kept and all("v=v1" in f for f in kept), "an untouched day keeps its files"
    assert not [f for f in files() if "v=v2/first_seen=2024-01-02" in f], "a replaced day goes one version later"
    got = {(r.title, str(r.first_seen), r.status, r.attempts) for r in sinks.read_history(spark, root).collect()}
    assert got == {("a", "2024-01-01", "new", 1), ("b", "2024-01-01", "new", 1), ("c", "2024-01-02", "new", 2),
                   ("d", "2024-01-03", "new", 1), ("e", "2024-01-04", "new", 1)}
    assert sinks.current_version(spark, root) == sinks.version_path(root, "v4")


def chain(n):
    """Titles of nine words that drift: each is like the one before and the one after, and like no other."""
    return [{"title": " ".join(f"w{j}x" for j in range(i, i + 9)), "company": "Hot", "description": ""} for i in range(n)]


def unlike(n):
    """Titles that share a word and are all unlike."""
    return [{"title": f"engineer a{i}x b{i}x", "company": "Hot", "description": ""} for i in range(n)]


@pytest.mark.parametrize("leaders", [2, 64])
def test_a_long_chain_is_settled_in_order(spark, leaders):
    frame = posts(spark, chain(151)).repartition(4, F.rand(3))
    assert kept(dedup.filter_new(frame, no_history(spark), DAY, leaders_per_bucket=leaders)) == list(range(0, 151, 2))


def test_rounds_do_not_grow_with_the_bucket(spark, monkeypatch):
    written = []
    plain = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: (written.append(None), plain(df))[1])
    counts = []
    for n in (18, 180, 1800):
        written.clear()
        rows = posts(spark, unlike(n) + [{"title": f"engineer a{n - 1}x b{n - 1}x", "company": "Hot", "description": ""}])
        assert kept(dedup.filter_new(rows, no_history(spark), DAY, leaders_per_bucket=4)) == list(range(n))
        counts.append(len(written))
    assert counts[0] == counts[1] == counts[2]


def random_sets(seed, n, most, vocabulary=25):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), i, sorted(rnd.sample(range(vocabulary), rnd.randint(1, most)))) for i in range(n)]


SETS = "block string, id bigint, tokens array<bigint>"


@pytest.mark.parametrize("seed,most,vocabulary", [(1, 5, 6), (2, 11, 12), (3, 20, 21)])
def test_short_sets_meet_only_if_similar(spark, monkeypatch, seed, most, vocabulary):
    sets = list({(b, tuple(t)): (b, i, t) for b, i, t in random_sets(seed, 150, most, vocabulary)}.values())
    checked = []
    plain = sim.verify
    monkeypatch.setattr(sim, "verify", lambda pairs, *rest: (checked.append(pairs), plain(pairs, *rest))[1])
    got = sim.similar_short_pairs(spark.createDataFrame(sets, SETS), 0.8)
    want = {(a[1], b[1]) for a in sets for b in sets if a[1] < b[1] and a[0] == b[0] and jac(set(a[2]), set(b[2])) >= 0.8}
    assert {(r.id_a, r.id_b) for r in got.collect()} == want and want
    small = {s[1] for s in sets if len(s[2]) <= sim.SHORT_SET}
    assert checked[0].count() == len([p for p in want if set(p) <= small]), "every candidate is similar"


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_existence_join(spark, monkeypatch, threshold):
    left, right = random_sets(7, 90, 12, 14), random_sets(8, 60, 12, 14)
    left += [("a", 500 + i, left[0][2]) for i in range(3)] + [("a", 600, []), ("c", 601, [1, 2])]
    frames = [spark.createDataFrame(x, SETS) for x in (left, right)]
    want = {a[1] for a in left if any(a[0] == b[0] and jac(set(a[2]), set(b[2])) >= threshold for b in right)}
    assert {r.id for r in sim.with_similar(*frames, threshold).collect()} == want
    back = {b[1] for b in right if any(a[0] == b[0] and jac(set(a[2]), set(b[2])) >= threshold for a in left)}
    assert {r.id for r in sim.with_similar(*frames[::-1], threshold).collect()} == back


def test_a_row_found_at_once_is_verified_once(spark, monkeypatch):
    shared = list(range(40))
    left = [("a", i, shared + [1000 + i]) for i in range(50)]
    right = [("a", i, shared + [2000 + i]) for i in range(30)]
    verified = []
    plain = sim.verify
    monkeypatch.setattr(sim, "verify", lambda pairs, *rest: (verified.append(pairs), plain(pairs, *rest))[1])
    found = sim.with_similar(*(spark.createDataFrame(x, SETS) for x in (left, right)), 0.6)
    assert found.count() == 50
    assert sum(v.count() for v in verified) == 50, "not one for each pair"


def test_prefixes_are_ranked_by_one_sort_of_numbers(spark):
    """Members of a set are not collected into lists, of which nearly every row would be one before the shuffle."""
    sets = spark.createDataFrame([("b", 1, [1, 2, 3, 4, 5]), ("b", 2, [1, 2, 3, 4, 9]), ("b", 3, [7, 8])], SETS)
    keys = sim.prefix_entries(sets, 0.6)
    assert "collect_list" not in keys._jdf.queryExecution().toString()
    # what no other set has is first and is left out; then the rarest
    assert sorted((r.id, r.token, r.n) for r in keys.collect()) == [(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 2, 5)]


def test_only_texts_that_may_have_a_like_one_are_compared(spark, monkeypatch):
    """Members are counted in parts; what is alone is not compared, and what is like another is always found."""
    monkeypatch.setattr(sim, "PART_MEMBERS", 0)
    rnd = random.Random(5)
    texts = [" ".join(f"{t}w{rnd.randrange(400)}" for _ in range(60)) for t in range(40)]
    texts += [texts[i].rsplit(" ", 6)[0] + " else where" for i in range(8)] + texts[3:5]
    rows = dedup.with_keys(posts(spark, [{"company": f"Firm{i % 2}", "description": t} for i, t in enumerate(texts)]))
    compared = []
    plain = sim.similar_pairs
    monkeypatch.setattr(sim, "similar_pairs", lambda sets, *rest: (compared.append(sets.count()), plain(sets, *rest))[1])
    runs = {r.pos: (r.company_key, set(r.runs)) for r in dedup.comparable(rows).collect()}
    want = {(a, b) for a in runs for b in runs if a < b and runs[a][0] == runs[b][0] and jac(runs[a][1], runs[b][1]) >= 0.6}
    got = {(r.id_a, r.id_b): r.similarity for r in dedup.near_description_pairs(rows).collect()}
    # copies are linked to their first copy only
    assert got.keys() <= want and {b for _, b in want} == {b for _, b in got} and len(got) >= 8
    assert all(round(jac(runs[a][1], runs[b][1]), 9) == round(s, 9) for (a, b), s in got.items())
    assert compared == [len({x for pair in want for x in pair} - {48, 49})], "not all 48 different texts"


def test_tables_of_a_search_are_deleted(spark):
    rows = dedup.with_keys(posts(spark, [{"company": "Alder", "description": f"{LONG} {i}"} for i in range(5)]))
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert dedup.near_description_pairs(rows).count() == 10
    assert [p.name.partition("-")[0] for p in set(folder.iterdir()) - before] == ["pairs"]


def test_a_batch_in_parts_is_decided_alike_and_leaves_outcomes_only(spark, monkeypatch):
    monkeypatch.setattr(sim, "PART_MEMBERS", 0)
    monkeypatch.setattr(sim, "PARTS", 3)
    rows = posts(spark, fuzzy_batch(6, 60))
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    got = dedup.filter_new(rows, no_history(spark), DAY, leaders_per_bucket=2)
    assert len(set(folder.iterdir()) - before) == 1
    assert kept(got) == brute(dedup.with_keys(rows).collect())
