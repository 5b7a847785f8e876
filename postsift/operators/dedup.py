"""Exact, prioritised, fuzzy and incremental duplicate removal.

``pos`` is the arrival order and breaks every tie. Operators take and return
DataFrames; only :func:`filter_new` runs jobs of its own, because deciding which
rows survive depends on which earlier rows did.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.operators import similarity as sim
from postsift.operators.keyed import anti_on_key, first_n_per_key
from postsift.session import scratch_space, stored
from postsift.session import stored as cut_lineage

#: How many of its earliest members a bucket is compared with per round, and how
#: many when it has more members than that.
LEADERS_PER_BUCKET = 64
FEW_LEADERS = 8


def _lasting(df: DataFrame) -> DataFrame:
    return stored(df, lasting=True)


def dedup_url(rows: DataFrame) -> DataFrame:
    """First row per url in arrival order; rows without a url are dropped."""
    trimmed = rows.withColumn("url", F.btrim(tx.text_or_empty(F.col("url")))).filter("url != ''")
    return first_n_per_key(trimmed, ["url"], [F.col("pos")])


def priority_of(site: Column, priority: dict[str, int] | None = None) -> Column:
    table = fixed.SITE_PRIORITY if priority is None else priority
    rank = F.lit(fixed.UNLISTED_PRIORITY)
    for name, number in table.items():
        rank = F.when(site == name, F.lit(number)).otherwise(rank)
    return rank


def dedup_cross_source(rows: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """One row per in-run key: best site, then longest description, then first.

    Rows without a key are always kept. Survivors keep their own positions.
    """
    keyed = rows.withColumn("_key", tx.loose_key(F.col("title"), F.col("company")))
    best = first_n_per_key(
        keyed.filter("_key != ''"),
        ["_key"],
        [
            priority_of(F.col("site"), priority),
            -F.length(tx.text_or_empty(F.col("description"))),
            F.col("pos"),
        ],
    )
    return best.unionByName(keyed.filter("_key = ''")).drop("_key")


def settled(history: DataFrame, retries: int = fixed.ERROR_RETRIES) -> DataFrame:
    """History rows that count as seen: scoring errors with retries left do not."""
    return history.filter(
        f"NOT (status = 'scoring_error' AND coalesce(attempts, 1) <= {int(retries)})"
    )


def snapshot(
    history: DataFrame,
    today: dt.date,
    lookback: int = fixed.LOOKBACK_DAYS,
    retries: int = fixed.ERROR_RETRIES,
) -> tuple[DataFrame, DataFrame]:
    """(known urls over all history, known adverts inside the lookback window)."""
    rows = settled(history, retries)
    cutoff = today - dt.timedelta(days=lookback)
    recent = rows.filter(F.col("first_seen") >= F.lit(cutoff))
    return rows.select("job_id"), recent.select("job_id", "title", "company", "desc_head")


def with_keys(rows: DataFrame) -> DataFrame:
    """Add the keys every check compares, each computed once."""
    return rows.withColumns({
        "job_id": tx.job_id(F.col("url")),
        "company_key": tx.company_key(F.col("company")),
        "title_key": tx.title_key(F.col("title")),
        "desc_head": tx.description_head(F.col("description")),
    }).withColumns({
        "content_key": F.when(
            (F.col("title_key") != "") & (F.col("company_key") != ""),
            F.concat_ws("|", "title_key", "company_key"),
        ).otherwise(F.lit("")),
        # Stands for the head wherever only equality matters, so that the text
        # itself stays out of the shuffles.
        "head_id": F.when(F.col("desc_head") != "", F.md5("desc_head")).otherwise(F.lit("")),
    })


def anti_known_url(rows: DataFrame, known_urls: DataFrame) -> DataFrame:
    return rows.join(known_urls.select("job_id").distinct(), "job_id", "left_anti").select(rows.columns)


def anti_known_content(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Drop rows whose content key is known; an empty key never matches."""
    return anti_on_key(rows, known, "content_key")


# --- near duplicates --------------------------------------------------------------


def comparable(rows: DataFrame, *also: str) -> DataFrame:
    """What the checks compare, without the texts: (pos, keys, title words, runs and their number).

    Rows need ``pos``, ``title`` and the columns of :func:`with_keys`.
    """
    read = rows.select(
        "pos",
        *also,
        "job_id",
        "company_key",
        "title_key",
        "content_key",
        "head_id",
        (tx.text_or_empty(F.col("title")) == "").alias("untitled"),
        F.array_sort(F.array_distinct(tx.words_of(F.col("title_key")))).alias("words"),
        tx.shingle_hashes(F.col("desc_head")).alias("runs"),
    )
    return read.withColumn("n", F.size("runs"))


def _title_members(rows: DataFrame) -> DataFrame:
    """(block, identity, pos, tokens): rows whose title has at least two words."""
    return rows.filter("company_key != '' AND size(words) >= 2").select(
        F.col("company_key").alias("block"), F.array_join("words", " ").alias("identity"),
        "pos", F.col("words").alias("tokens"),
    )


def _texts(table: DataFrame) -> DataFrame:
    """(uid, pos, n, salt, tokens): rows of a stored :func:`comparable` whose description can be compared.

    The runs are most of what is stored, so they are read where they are and only fetched for texts that may have a like
    one. Equal texts of a company have one ``uid``; ``salt`` stands for the company.
    """
    return table.filter("company_key != '' AND n > 0").select(
        F.xxhash64("company_key", "head_id").alias("uid"), "pos", "n", F.xxhash64("company_key").alias("salt"), F.col("runs").alias("tokens"))


def _fetched(texts: DataFrame, wanted: DataFrame, keep=cut_lineage) -> DataFrame:
    """(uid, salt, tokens and what else ``wanted`` has) for the (uid, pos) that are wanted, one for each."""
    parts = sim.parts_for(texts.agg(F.sum("n")).first()[0])
    place, found = ["uid", "pos"], None
    for i in range(parts):
        # the place alone makes copies of a text many keys
        some = texts.filter(sim.in_part("uid", parts, i)).drop("n").join(wanted.filter(sim.in_part("uid", parts, i)), place).dropDuplicates(place)
        part = keep(some.drop("pos"))
        found = part if found is None else found.unionByName(part)
    return found


def _sets(members: DataFrame) -> DataFrame:
    """One (block, identity, id, tokens) per distinct value; id = its first position."""
    firsts = first_n_per_key(members, ["block", "identity"], [F.col("pos")])
    return firsts.select("block", "identity", F.col("pos").alias("id"), "tokens")


def _with_copies(members: DataFrame, threshold: float, join=sim.similar_pairs) -> DataFrame:
    """Pairs between distinct values, plus every copy linked to its first copy.

    The members are written out once: they are read for the keys, for the
    counts of the keys and again for the final check.
    """
    members = cut_lineage(members)
    sets = cut_lineage(_sets(members))
    pairs = join(sets, threshold, cut_lineage)
    links = (
        members.select("block", "identity", F.col("pos").alias("id_b"))
        .join(sets.select("block", "identity", F.col("id").alias("id_a")), ["block", "identity"])
        .filter("id_b > id_a")
        .select("block", "id_a", "id_b", F.lit(1.0).alias("similarity"))
    )
    return pairs.select("block", "id_a", "id_b", "similarity").unionByName(links)


def near_title_pairs(rows: DataFrame, threshold: float = fixed.NEAR_TITLE) -> DataFrame:
    """Same company, similar titles. Copies are links to the first copy."""
    with scratch_space(rows.sparkSession):
        read = comparable(rows).select("pos", "company_key", "words")
        return stored(_with_copies(_title_members(cut_lineage(read)), threshold, sim.similar_short_pairs), "pairs", lasting=True)


def near_description_pairs(rows: DataFrame, threshold: float = fixed.NEAR_DESCRIPTION) -> DataFrame:
    """Same company, similar descriptions. Copies are links to the first copy."""
    spark = rows.sparkSession
    value = ["block", "identity"]
    with scratch_space(spark):
        with scratch_space(spark):
            # Written before it is filtered: a filter on a key would read the whole text once more for the filter alone.
            table = cut_lineage(comparable(rows).select("pos", "company_key", "head_id", "runs", "n"))
            named = table.filter("company_key != '' AND head_id != ''").select(
                F.col("company_key").alias("block"), F.col("head_id").alias("identity"), "pos")
            # a first copy without a position is like none
            firsts = cut_lineage(named.groupBy(*value).agg(F.min(F.struct("pos")).getField("pos").alias("id")).filter("id IS NOT NULL"))
            links = stored(
                named.withColumnRenamed("pos", "id_b").join(firsts.withColumnRenamed("id", "id_a"), value).filter("id_b > id_a")
                .select("block", "id_a", "id_b", F.lit(1.0).alias("similarity")), "links", lasting=True)
            texts = _texts(table)
            able = sim.accompanied(texts, threshold, cut_lineage)
            wanted = firsts.withColumns({"uid": F.xxhash64(*value), "pos": F.col("id")}).join(able.select("uid"), "uid", "left_semi")
            sets = _fetched(texts, wanted.drop("identity"), _lasting)
        pairs = sim.similar_pairs(sets.select("block", "id", "tokens"), threshold, cut_lineage)
        return stored(pairs.select("block", "id_a", "id_b", "similarity").unionByName(links), "pairs", lasting=True)


# --- the incremental filter ---------------------------------------------------------


def _window_rows(known: DataFrame) -> DataFrame:
    """The history window in the shape of :func:`comparable`."""
    head = tx.text_or_empty(F.col("desc_head"))
    return comparable(
        known.withColumns({
            "pos": F.xxhash64("job_id"),
            "company_key": tx.company_key(F.col("company")),
            "title_key": tx.title_key(F.col("title")),
            "desc_head": head,
            "head_id": F.when(head != "", F.md5(head)).otherwise(F.lit("")),
        }).withColumn(
            "content_key",
            F.when(
                (F.col("title_key") != "") & (F.col("company_key") != ""),
                F.concat_ws("|", "title_key", "company_key"),
            ).otherwise(F.lit("")),
        )
    )


def _near_history(rows: DataFrame, window: DataFrame, texts: DataFrame, old_texts: DataFrame, able: DataFrame) -> DataFrame:
    """Positions of batch rows that nearly repeat a posting of the window; the texts of ``able`` may have a like one."""
    members, old = _title_members(rows), _title_members(window.filter("NOT untitled"))
    # Each is read for its keys, for the counts of the keys and for the check.
    left, right = cut_lineage(_sets(members)), cut_lineage(_sets(old))
    values = left.join(sim.with_similar(left, right, fixed.NEAR_TITLE, cut_lineage), "id", "left_semi").select("block", "identity")
    hits = members.join(values, ["block", "identity"], "left_semi").select("pos")
    # An equal text settles a row; the others need the runs, as far as there may be a like one.
    described = rows.filter("company_key != '' AND n > 0").select("company_key", "head_id", "pos", F.xxhash64("company_key", "head_id").alias("uid"))
    known = window.filter("NOT untitled AND company_key != '' AND n > 0").select("company_key", "head_id").distinct()
    same = described.join(known, ["company_key", "head_id"], "left_semi").select("pos")
    rest = cut_lineage(described.join(known, ["company_key", "head_id"], "left_anti").join(able, "uid", "left_semi").select("uid", "pos"))
    wanted = [side.groupBy("uid").agg(F.min("pos").alias("pos")) for side in (rest, old_texts.select("uid", "pos").join(able, "uid", "left_semi"))]
    sets = [_fetched(*side).select(F.col("salt").alias("block"), F.col("uid").alias("id"), "tokens") for side in zip((texts, old_texts), wanted)]
    like = sim.with_similar(*sets, fixed.NEAR_DESCRIPTION, cut_lineage).withColumnRenamed("id", "uid")
    return hits.unionByName(same).unionByName(rest.join(like, "uid", "left_semi").select("pos")).distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """Rows that agree on company, title key and head decide alike: fold them.

    Rows without a title never stand in another row's way (``blocks`` is false)
    and stay single, because each is judged by what came before it. So do rows
    with neither a title key nor a head: nothing makes them alike.
    """
    alone = F.col("untitled") | ((F.col("title_key") == "") & (F.col("head_id") == ""))
    folded = first_n_per_key(
        rows.withColumn("solo", F.when(alone, F.col("pos"))),
        ["company_key", "title_key", "head_id", "solo"],
        [F.col("pos")],
    )
    return folded.select(
        "company_key", "title_key", (~F.col("untitled")).alias("blocks"),
        F.col("pos").alias("id"), "words",
        F.when(F.col("n") > 0, F.xxhash64("company_key", "head_id")).alias("uid"),
    )


def _with_runs(classes: DataFrame, texts: DataFrame, able: DataFrame) -> DataFrame:
    """``classes`` with the runs of those whose text may be like another's; the others have none."""
    held = classes.filter("uid IS NOT NULL").groupBy("uid").agg(F.min("id").alias("pos"), F.count("*").alias("held"))
    near = able.select("uid", F.lit(True).alias("near"))
    wanted = held.join(near, "uid", "left").filter("near OR held > 1").select("uid", "pos")
    runs = _fetched(texts, wanted).select("uid", F.col("tokens").alias("runs"))
    return classes.join(runs, "uid", "left").drop("uid").withColumn("runs", F.coalesce("runs", F.array().cast("array<bigint>")))


def _buckets(classes: DataFrame) -> DataFrame:
    """(kind, block, token, id, n): where similar classes are sure to meet."""
    titled = classes.filter(F.size("words") >= 2).select(
        F.col("company_key").alias("block"), "id", F.col("words").alias("tokens")
    )
    described = classes.filter(F.size("runs") > 0).select(
        F.col("company_key").alias("block"), "id", F.col("runs").alias("tokens")
    )
    hashed = titled.withColumn("tokens", F.transform("tokens", lambda w: F.xxhash64(w)))
    by_title = sim.prefix_entries(hashed, fixed.NEAR_TITLE).withColumn("kind", F.lit("title"))
    by_text = sim.prefix_entries(described, fixed.NEAR_DESCRIPTION).withColumn("kind", F.lit("text"))
    by_key = classes.filter("title_key != ''").select(
        F.col("company_key").alias("block"),
        F.xxhash64("title_key").alias("token"),
        "id",
        F.lit(0).alias("n"),
        F.lit("key").alias("kind"),
    )
    return by_title.unionByName(by_text).unionByName(by_key)


def _leaders(entries: DataFrame, most: int) -> DataFrame:
    """The earliest blocking classes of every bucket, which the others are
    compared with: all of a small bucket, a few of a large one. ``whole`` says
    whether these are all the blocking classes the bucket has."""
    bucket = ["kind", "block", "token"]
    blocking = entries.filter("blocks")
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("id"))
    first = blocking.withColumn("rank", rank).filter(F.col("rank") <= most)
    sizes = blocking.groupBy(*bucket).agg(F.count("*").alias("held"))
    few = min(FEW_LEADERS, most)
    return first.join(sizes, bucket).filter((F.col("held") <= most) | (F.col("rank") <= few)).select(
        *bucket, "id", "n", (F.col("held") <= most).alias("whole")
    )


def _edges(entries: DataFrame, leaders: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst): an earlier leader that really is a near copy of a later class."""
    bucket = ["kind", "block", "token"]
    met = entries.join(
        leaders.select(*bucket, F.col("id").alias("src"), F.col("n").alias("n_src")), bucket
    ).filter(F.col("src") < F.col("id"))
    edges = met.filter("kind = 'key'").select("src", F.col("id").alias("dst"))
    # Only what a kind compares is fetched for its candidates.
    for kind, tokens, threshold in (("title", "words", fixed.NEAR_TITLE), ("text", "runs", fixed.NEAR_DESCRIPTION)):
        fits = F.least("n", "n_src") >= F.lit(threshold) * F.greatest("n", "n_src") - F.lit(1e-9)
        near = met.filter((F.col("kind") == kind) & fits).select(
            F.col("src").alias("id_a"), F.col("id").alias("id_b")
        ).distinct()
        sets = classes.select("id", F.col(tokens).alias("tokens"))
        same = sim.verified(near, sets, sets, threshold, cut_lineage)
        edges = edges.unionByName(same.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    return edges.distinct()


def _settle(edges: DataFrame, state: DataFrame) -> DataFrame:
    """One step: reject what an accepted row blocks, accept what nothing earlier can."""
    source = state.select(F.col("id").alias("src"), F.col("state").alias("src_state"))
    pressure = (
        edges.join(source, "src")
        .groupBy(F.col("dst").alias("id"))
        .agg(
            F.bool_or(F.col("src_state") == "new").alias("blocked"),
            F.bool_or(F.col("src_state") == "open").alias("waiting"),
        )
    )
    return state.join(pressure, "id", "left").select(
        "id",
        "covered",
        F.when(F.col("state") != "open", F.col("state"))
        .when(F.col("blocked"), F.lit("repeat"))
        .when(F.col("covered") & ~F.coalesce("waiting", F.lit(False)), F.lit("new"))
        .otherwise(F.lit("open"))
        .alias("state"),
    )


def _groups(classes: DataFrame) -> DataFrame:
    """(kind, block, identity, id, tokens): what a class is compared by. Classes of one identity are alike."""
    block = F.col("company_key").alias("block")
    key = classes.filter("title_key != ''").select(
        F.lit("key").alias("kind"), block, F.xxhash64("title_key", F.lit("key")).alias("identity"), "id", F.lit(None).cast("array<bigint>").alias("tokens"))
    hashes = F.sort_array(F.transform("words", lambda w: F.xxhash64(w)))
    title = classes.filter(F.size("words") >= 2).select(
        F.lit("title").alias("kind"), block, F.xxhash64(hashes, F.lit("title")).alias("identity"), "id", hashes.alias("tokens"))
    text = classes.filter(F.size("runs") > 0).select(
        F.lit("text").alias("kind"), block, F.xxhash64(F.sort_array("runs"), F.lit("text")).alias("identity"), "id", F.col("runs").alias("tokens"))
    return key.unionByName(title).unionByName(text)


def _links(groups: DataFrame) -> DataFrame:
    """(identity, other), both ways: similar identities of one company, and each identity with itself.

    Every pair of different values is compared once, in one join for titles and one for texts, and copies are not
    expanded into pairs: they share their identity.
    """
    sets = first_n_per_key(groups, ["kind", "block", "identity"], [F.col("id")])
    place = F.xxhash64("block", "identity")
    found = None
    for kind, join, threshold in (
        ("title", sim.similar_short_pairs, fixed.NEAR_TITLE), ("text", sim.similar_pairs, fixed.NEAR_DESCRIPTION),
    ):
        mine = cut_lineage(sets.filter(F.col("kind") == kind).select("block", place.alias("id"), "tokens"))
        pairs = join(mine, threshold, cut_lineage).select(F.col("id_a").alias("identity"), F.col("id_b").alias("other"))
        found = pairs if found is None else found.unionByName(pairs)
    alone = sets.select(place.alias("identity"), place.alias("other"))
    return found.unionByName(found.select(F.col("other").alias("identity"), F.col("identity").alias("other"))).unionByName(alone)


#: Steps taken by all rows at once before what still waits is walked in order.
PARALLEL_STEPS = 3


def _step(members: DataFrame, links: DataFrame, state: DataFrame, keep: bool = True) -> DataFrame:
    """Reject what an earlier kept row blocks; with ``keep``, keep what no earlier open row can block."""
    first = lambda kind: F.min(F.when((F.col("state") == kind) & F.col("blocks"), F.col("id")))
    of_group = members.join(state, "id").groupBy("identity").agg(first("new").alias("kept"), first("open").alias("open"))
    near = links.join(of_group.withColumnRenamed("identity", "other"), "other").groupBy("identity").agg(
        F.min("kept").alias("kept"), F.min("open").alias("open"))
    of_row = members.join(near, "identity").groupBy("id").agg(F.min("kept").alias("kept"), F.min("open").alias("open"))
    return state.join(of_row, "id", "left").select(
        "id", "blocks",
        F.when(F.col("state") != "open", F.col("state")).when(F.col("kept") < F.col("id"), F.lit("repeat"))
        .when(F.lit(keep) & ~F.coalesce(F.col("open") < F.col("id"), F.lit(False)), F.lit("new")).otherwise(F.lit("open"))
        .alias("state"))


def _walked(members: DataFrame, links: DataFrame, state: DataFrame) -> DataFrame:
    """(id, state) of what is open after the steps: long chains, each row waiting for the one before it.

    Whether such a row stays depends on all before it, so a company's open rows are read in order, as a stream
    that holds nothing but which identities have a kept row; companies are spread over tasks.
    """
    left = state.filter("state = 'open'").select("id", "blocks")
    mine = members.join(left, "id")
    reach = mine.join(links, "identity").select("block", "id", "blocks", "other", (F.col("other") == F.col("identity")).alias("own"))
    # only what another open row is in can matter here: kept rows have blocked all they can
    rows = reach.join(mine.select(F.col("identity").alias("other")).distinct(), "other")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = row = None
        blocks, own, blocked = False, [], False
        kept: set[int] = set()
        done: list[tuple] = []

        def settle() -> None:
            if row is not None:
                done.append((row, "repeat" if blocked else "new"))
                if not blocked and blocks:
                    kept.update(own)

        for batch in batches:
            for b, i, does, other, is_own in zip(*(c.to_pylist() for c in batch.columns)):
                if (b, i) != (block, row):
                    settle()
                    if b != block:
                        kept.clear()
                    block, row, blocks, own, blocked = b, i, does, [], False
                blocked = blocked or other in kept
                if is_own:
                    own.append(other)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["id", "state"])
                done.clear()
        settle()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["id", "state"])

    ordered = rows.repartition("block").sortWithinPartitions("block", "id").select("block", "id", "blocks", "other", "own")
    return ordered.mapInArrow(walk, "id long, state string")


def _settled(classes: DataFrame) -> DataFrame:
    """(id, state): the first-come selection, with all similar pairs at hand; as many jobs for any size of bucket."""
    groups = cut_lineage(_groups(classes))
    links = cut_lineage(_links(groups))
    members = groups.select("id", "block", F.xxhash64("block", "identity").alias("identity"))
    state = classes.select("id", "blocks", F.lit("open").alias("state"))
    for _ in range(PARALLEL_STEPS):
        state = cut_lineage(_step(members, links, state))
    state = cut_lineage(_step(members, links, state, keep=False))
    walked = _walked(members, links, state)
    return state.filter("state != 'open'").select("id", "state").unionByName(walked)


def _greedy(classes: DataFrame, leaders_per_bucket: int) -> DataFrame:
    """(id, state): the first-come selection among the classes of one batch.

    First every class is compared with at most ``leaders_per_bucket`` of the earliest classes of each bucket it is in
    (a few, where the bucket is large), which settles near copies of early rows with pairs linear in the rows. A class
    that is not settled by that, since its bucket goes on, is compared with all others that are left, once, by
    :func:`_settled`. So there are two rounds, however large a bucket is, and nothing is capped.
    """
    entries = cut_lineage(_buckets(classes).join(classes.select("id", "blocks"), "id"))
    leaders = cut_lineage(_leaders(entries, leaders_per_bucket))
    partly = leaders.filter("NOT whole").groupBy("kind", "block", "token").agg(F.max("id").alias("last"))
    uncovered = (
        entries.join(partly, ["kind", "block", "token"])
        .filter(F.col("id") > F.col("last"))
        .select("id")
        .distinct()
        .withColumn("late", F.lit(True))
    )
    edges = cut_lineage(_edges(entries, leaders, classes))
    state = classes.select("id").join(uncovered, "id", "left").select(
        "id", F.col("late").isNull().alias("covered"), F.lit("open").alias("state"))
    for _ in range(PARALLEL_STEPS):
        state = cut_lineage(_settle(edges, state))
    # what the last step kept has yet to block others
    state = cut_lineage(_settle(edges, state.withColumn("covered", F.lit(False))))
    decided = state.filter("state != 'open'").select("id", "state")
    still = state.filter("state = 'open'").select("id")
    if still.isEmpty():
        return decided
    # what is left was not blocked by anything kept so far, but what is kept later may be blocked by nothing else
    return decided.unionByName(cut_lineage(_settled(cut_lineage(classes.join(still, "id", "left_semi")))))


def filter_new(
    rows: DataFrame,
    history: DataFrame,
    today: dt.date,
    lookback: int = fixed.LOOKBACK_DAYS,
    retries: int = fixed.ERROR_RETRIES,
    leaders_per_bucket: int = LEADERS_PER_BUCKET,
) -> DataFrame:
    """Every row with ``outcome``: ``new``, or skipped by ``url``, ``content`` or ``near``.

    Checked against history first, then, in arrival order, against the rows of
    this batch that were themselves kept; a skipped row never hides a later one.
    A url that an earlier row of the batch has is skipped by ``url``. A row without
    a url is judged by what it says.
    """
    trimmed = rows.withColumn("url", F.btrim(tx.text_or_empty(F.col("url"))))
    with scratch_space(rows.sparkSession):
        outcomes = stored(_outcomes(trimmed, history, today, lookback, retries, leaders_per_bucket), "outcomes", lasting=True)
    return trimmed.join(outcomes, "pos")


def _outcomes(
    trimmed: DataFrame, history: DataFrame, today: dt.date, lookback: int, retries: int, leaders_per_bucket: int,
) -> DataFrame:
    """(pos, outcome) of every row. All but the fetching of runs works on what is left of a row without its texts and runs."""
    blank = F.col("url") == ""
    # a blank url is nobody's id
    keyed = with_keys(trimmed).withColumn("job_id", F.when(~blank, F.col("job_id")))
    known_urls, known = snapshot(history, today, lookback, retries)
    with scratch_space(trimmed.sparkSession):
        table = cut_lineage(comparable(keyed, "url"))
        window = cut_lineage(_window_rows(known))
        texts, old_texts = _texts(table), _texts(window.filter("NOT untitled"))
        able = sim.accompanied(texts.unionByName(old_texts), fixed.NEAR_DESCRIPTION, cut_lineage).select("uid")
        every = table.drop("runs")
        batch = _lasting(first_n_per_key(every.filter(~blank), ["url"], [F.col("pos")]).unionByName(every.filter(blank)).drop("url"))
        repeats = _lasting(every.select("pos").join(batch.select("pos"), "pos", "left_anti").withColumn("outcome", F.lit("url")))
        known_keys = _lasting(window.select("content_key").filter("content_key != ''").distinct())
        fresh_url = anti_known_url(batch, known_urls)
        fresh = _lasting(anti_known_content(fresh_url, known_keys))
        named = fresh.filter("company_key != ''")
        with scratch_space(trimmed.sparkSession):
            near = _lasting(_near_history(named, window, texts, old_texts, able))
        near = _lasting(near)
        undecided = _lasting(named.join(near, "pos", "left_anti"))
        classes = _lasting(_with_runs(cut_lineage(_classes(undecided)), texts, able))
    decided = _greedy(classes, leaders_per_bucket)
    # The kept row of a class is its first; the others repeat it. Rows without a
    # title were decided one by one, so each is its own first.
    kept = decided.filter("state = 'new'").select(F.col("id").alias("pos"), F.lit(True).alias("is_new"))
    slim = ["pos", "content_key"]
    kept_keys = (
        undecided.select(*slim).filter("content_key != ''").join(kept, "pos")
        .groupBy("content_key").agg(F.min("pos").alias("kept_pos"))
    )
    in_batch = (
        undecided.select(*slim).join(kept, "pos", "left")
        .join(kept_keys, "content_key", "left")
        .select(
            "pos",
            F.when(F.col("is_new"), F.lit("new"))
            .when(F.col("kept_pos") < F.col("pos"), F.lit("content"))
            .otherwise(F.lit("near"))
            .alias("outcome"),
        )
    )
    outcomes = (
        batch.join(known_urls.distinct(), "job_id", "left_semi").select("pos", F.lit("url").alias("outcome"))
        .unionByName(
            fresh_url.filter("content_key != ''").join(known_keys, "content_key", "left_semi")
            .select("pos", F.lit("content").alias("outcome"))
        )
        .unionByName(near.select("pos", F.lit("near").alias("outcome")))
        .unionByName(fresh.filter("company_key = ''").select("pos", F.lit("new").alias("outcome")))
        .unionByName(in_batch)
    )
    return outcomes.unionByName(repeats)


def upsert_seen(scored: DataFrame, history: DataFrame, today: dt.date) -> DataFrame:
    """The next version of the history table.

    New ids are inserted. A stored scoring error gets the new score, status,
    verdict and one more attempt. Every other stored row is left alone. Within a
    batch, a repeated id after the first only counts if what it meets is an error.
    """
    batch = scored.withColumns({
        "job_id": tx.job_id(F.col("url")),
        "desc_head": tx.description_head(F.col("description")),
        "status": F.coalesce("status", F.lit("new")),
        "verdict_json": tx.text_or_empty(F.col("verdict_json")),
        "score": F.col("score").cast("double"),
    })
    columns = history.columns
    # Only the writes up to and including the first that is not an error have an
    # effect. Two aggregations and a join, so a repeated id is never one task's.
    closing = (
        batch.filter("status != 'scoring_error'").groupBy("job_id").agg(F.min("pos").alias("closed_at"))
    )
    writes = batch.join(closing, "job_id", "left").filter("closed_at IS NULL OR pos <= closed_at")
    folded = writes.groupBy("job_id").agg(
        F.count("*").cast("int").alias("b_writes"),
        F.max_by(F.struct("score", "status", "verdict_json"), "pos").alias("b_last"),
        F.min_by(
            F.struct("url", "title", "company", "location", "site", "date_posted", "search_term", "desc_head"),
            "pos",
        ).alias("b_first"),
    )
    joined = history.withColumn("stored", F.lit(True)).join(folded, "job_id", "full_outer")
    inserted = F.col("stored").isNull()
    retried = F.col("stored") & (F.col("status") == "scoring_error") & F.col("b_writes").isNotNull()
    out = {
        "score": F.when(inserted | retried, F.col("b_last.score")).otherwise(F.col("score")),
        "status": F.when(inserted | retried, F.col("b_last.status")).otherwise(F.col("status")),
        "verdict_json": F.when(inserted | retried, F.col("b_last.verdict_json")).otherwise(
            F.col("verdict_json")
        ),
        "attempts": F.when(inserted, F.col("b_writes"))
        .when(retried, F.coalesce("attempts", F.lit(1)) + F.col("b_writes"))
        .otherwise(F.col("attempts")),
        "first_seen": F.when(inserted, F.lit(today)).otherwise(F.col("first_seen")),
    }
    for name in ("url", "title", "company", "location", "site", "date_posted", "search_term", "desc_head"):
        out[name] = F.when(inserted, F.col(f"b_first.{name}")).otherwise(F.col(name))
    return joined.select("job_id", *[out[c].alias(c) for c in columns if c != "job_id"])


def seen_count(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("rows"))
