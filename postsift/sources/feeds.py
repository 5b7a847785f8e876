"""From landed feed rows to one table of postings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsift.functions import fixed
from postsift.functions import text as tx
from postsift.operators.keyed import anti_on_key, first_n_per_key
from postsift.schema import SEEN
from postsift.session import cut_lineage


# --- tables at rest ----------------------------------------------------------------------


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """The history table. Columns added since a file was written come out with
    their defaults; a filter on ``first_seen`` prunes partitions."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return complete_seen(rows)


def complete_seen(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    defaults = {"attempts": F.lit(1), "verdict_json": F.lit(""), "desc_head": F.lit("")}
    out = []
    for f in SEEN.fields:
        value = F.col(f.name) if f.name in have else F.lit(None)
        if f.name in defaults:
            value = F.coalesce(value, defaults[f.name])
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def read_outcomes(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The outcomes CSV, any extra columns ignored, a wrong header giving no rows.

    Quotes in a quoted cell are doubled. With ``multi_line`` a quoted cell may hold line breaks; a file is then one task.
    """
    rows = spark.read.csv(path, header=True, encoding="UTF-8", escape='"', multiLine=multi_line, mode="PERMISSIVE")
    return clean_outcomes(rows)


def clean_outcomes(rows: DataFrame) -> DataFrame:
    from postsift.operators.calibration import classify_status

    named: dict[str, str] = {}
    for column in rows.columns:
        named[column.lstrip("﻿").strip().lower()] = column
    wanted = ("title", "company", "status")
    if any(name not in named for name in wanted):
        empty = rows.sparkSession.createDataFrame([], "title string, company string, status string, class string")
        return empty
    cells = rows.select(
        *[F.btrim(tx.text_or_empty(F.col(f"`{named[n]}`"))).alias(n) for n in wanted],
    )
    kept = cells.filter("(title != '' OR company != '') AND status != ''")
    return kept.withColumn("class", classify_status(F.col("status")))


# --- per-feed projections -------------------------------------------------------------------


@dataclass(frozen=True)
class FeedMap:
    """How one feed's columns become a posting."""

    site: str
    company: tuple[str, ...] = ("company",)
    description: str | None = None
    job_type: str | None = None
    job_types: str | None = None


FEED_MAPS = {
    "jobbank": FeedMap("jobbank", description="description", job_type="jobType"),
    "jobnet": FeedMap("jobnet", company=("company", "hiringOrgName")),
    "jobdanmark": FeedMap("jobdanmark", company=("company", "companyName"), job_types="jobTypes"),
    "jobindex_cli": FeedMap("jobindex_cli"),
}


def _or_next(names) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def map_feed(items: DataFrame, feed: FeedMap, term: Column) -> DataFrame:
    """Posting rows; names arrive with HTML entities and are decoded."""
    job_type = F.lit("")
    if feed.job_type:
        job_type = tx.text_or_empty(F.col(feed.job_type))
    elif feed.job_types:
        job_type = F.coalesce(F.array_join(feed.job_types, ", "), F.lit(""))
    description = tx.html_to_text(F.col(feed.description)) if feed.description else F.lit("")
    keep = [c for c in ("pos", "id") if c in items.columns]
    return items.select(
        *keep,
        tx.html_unescape(tx.text_or_empty(F.col("title"))).alias("title"),
        tx.html_unescape(_or_next(feed.company)).alias("company"),
        tx.html_unescape(tx.text_or_empty(F.col("location"))).alias("location"),
        description.alias("description"),
        tx.text_or_empty(F.col("url")).alias("url"),
        F.lit(feed.site).alias("site"),
        tx.text_or_empty(F.col("date")).alias("date_posted"),
        F.lit("").alias("salary"),
        job_type.alias("job_type"),
        F.lit(False).alias("is_remote"),
        term.alias("search_term"),
    )


def map_paged(items: DataFrame, term: Column) -> DataFrame:
    """The paged board: RFC-2822 dates and split salary fields."""
    place = F.btrim(tx.text_or_empty(F.col("locations")))
    return items.select(
        "pos",
        F.btrim(tx.text_or_empty(F.col("title"))).alias("title"),
        F.btrim(tx.text_or_empty(F.col("company"))).alias("company"),
        place.alias("location"),
        F.btrim(tx.text_or_empty(F.col("description"))).alias("description"),
        F.btrim(tx.text_or_empty(F.col("url"))).alias("url"),
        F.lit("careerjet").alias("site"),
        tx.rfc2822_date(F.col("date")).alias("date_posted"),
        tx.format_salary(
            F.col("salary_min"), F.col("salary_max"), F.col("salary_currency_code"),
            tx.pay_suffix(F.col("salary_type")), F.col("salary"),
        ).alias("salary"),
        F.lit("").alias("job_type"),
        tx.detect_remote(F.lit(None).cast("boolean"), place).alias("is_remote"),
        term.alias("search_term"),
    )


def map_board(items: DataFrame, term: Column) -> DataFrame:
    """The main board: its own column names and split pay fields. A row without a url is no posting."""
    shown = {n: F.btrim(tx.text_or_empty(F.col(n).cast("string"))) for n in (
        "title", "company", "location", "description", "site", "date_posted", "job_type")}
    pay = tx.format_salary(
        F.col("min_amount").try_cast("double"), F.col("max_amount").try_cast("double"), F.col("currency"),
        tx.slash_suffix(F.col("interval")), F.lit(""))
    rows = items.select(
        *[c for c in ("pos", "id") if c in items.columns],
        *[value.alias(name) for name, value in shown.items()],
        F.btrim(tx.text_or_empty(F.col("job_url"))).alias("url"),
        pay.alias("salary"),
        F.coalesce(F.col("is_remote").try_cast("boolean"), F.lit(False)).alias("is_remote"),
        term.alias("search_term"),
    )
    return rows.filter("url <> ''")


# --- collecting ----------------------------------------------------------------------------------


def cap_per_search(
    rows: DataFrame, searches: list[tuple[str, int]], claim_first: bool = True
) -> DataFrame:
    """At most ``results_wanted`` url-unique rows per term, terms in order.

    With ``claim_first`` a url an earlier term already took does not count
    toward a later term's cap. A later term can lose at most as many urls as the
    earlier terms were allowed, so the first ``sum of the caps so far`` distinct
    urls of a term settle it: one ranked filter over all terms finds them. On these,
    rounds follow in which every term at once takes its first urls that no earlier
    term took the round before; term i is right after i + 1 rounds at the latest, and
    the rounds end when nothing changes. Without ``claim_first`` the cap comes before the url check.
    """
    number = F.create_map(*[F.lit(x) for i, (t, _) in enumerate(searches) for x in (t, i)])
    placed = rows.withColumn("_term", number[F.col("search_term")]).filter("_term IS NOT NULL")
    reach, total = [], 0
    for _, want in searches:
        total += want
        reach.append(total)
    limit = {name: F.create_map(*[F.lit(x) for pair in enumerate(values) for x in pair])[F.col("_term")]
             for name, values in (("want", [want for _, want in searches]), ("reach", reach))}
    rank = F.row_number().over(Window.partitionBy("_term").orderBy("pos"))

    def first(of: DataFrame, most: str, bound: int) -> DataFrame:
        # the plain bound lets Spark trim each term before the shuffle
        return of.withColumn("_rank", rank).filter((F.col("_rank") <= bound) & (F.col("_rank") <= limit[most])).drop("_rank")

    if not claim_first:
        capped = first(placed, "want", max(want for _, want in searches)).filter("url != ''")
        return first_n_per_key(capped, ["url"], [F.col("_term"), F.col("pos")]).drop("_term")
    firsts = first_n_per_key(placed.filter("url != ''"), ["_term", "url"], [F.col("pos")])
    small = cut_lineage(first(firsts.select("_term", "pos", "url"), "reach", total))
    picked = None
    for _ in searches:
        free = small
        if picked is not None:
            taken = picked.groupBy("url").agg(F.min("_term").alias("by"))
            free = small.join(taken, "url", "left").filter(F.coalesce(F.col("by") >= F.col("_term"), F.lit(True))).drop("by")
        before, picked = picked, cut_lineage(first(free, "want", max(want for _, want in searches)).select("_term", "pos", "url"))
        if before is not None and picked.exceptAll(before).isEmpty() and before.exceptAll(picked).isEmpty():
            break
    return placed.join(picked.select("_term", "pos"), ["_term", "pos"]).drop("_term")


@dataclass
class Collected:
    """One collecting run: the rows, and one report row per source."""

    rows: DataFrame
    per_source: DataFrame
    errors: dict[str, str] = field(default_factory=dict)


def union_feeds(
    spark: SparkSession, feeds: list[tuple[str, DataFrame | Callable[[], DataFrame]]]
) -> Collected:
    """All feeds in order, the first row per url kept across them.

    A feed that cannot be set up becomes an error entry, never a failed run.
    """
    parts, errors = [], {}
    for number, (name, feed) in enumerate(feeds):
        try:
            rows = feed() if callable(feed) else feed
            parts.append(
                rows.withColumn("url", F.btrim(tx.text_or_empty(F.col("url"))))
                .filter("url != ''")
                .withColumns({"feed": F.lit(name), "feed_ord": F.lit(number)})
            )
        except Exception as problem:  # a feed may fail in its own way
            errors[name] = str(problem)
    if not parts:
        raise ValueError(f"no feed could be read: {errors}")
    union = reduce(DataFrame.unionByName, parts)
    kept = first_n_per_key(union, ["url"], [F.col("feed_ord"), F.col("pos")])
    ran = spark.createDataFrame(
        [(name, errors.get(name)) for name, _ in feeds], "source string, error string"
    )
    counts = kept.groupBy(F.col("feed").alias("source")).agg(F.count("*").alias("n"))
    report = ran.join(counts, "source", "left").withColumn(
        "n", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0)))
    )
    return Collected(kept, report, errors)


def enrich_stub(
    rows: DataFrame,
    details: DataFrame,
    known_urls: DataFrame,
    known_keys: DataFrame,
    cap: int = fixed.DETAIL_CAP,
) -> DataFrame:
    """Give short, unknown rows the fetched detail text, each id asked for once
    and at most ``cap`` ids per feed; a blank detail leaves the row's own text."""
    keyed = rows.withColumns({
        "job_id": tx.job_id(F.col("url")),
        "content_key": tx.content_key(F.col("title"), F.col("company")),
    })
    stubs = keyed.filter(
        (F.length("description") < fixed.STUB_CHARS) & (F.coalesce("id", F.lit("")) != "")
    )
    unknown = anti_on_key(
        stubs.join(known_urls.select("job_id").distinct(), "job_id", "left_anti"), known_keys, "content_key"
    )
    asked = unknown.groupBy("feed", "id").agg(F.min("pos").alias("first_pos"))
    allowed = first_n_per_key(asked, ["feed"], [F.col("first_pos")], cap).select("feed", "id")
    # At most ``cap`` ids per feed: small by construction.
    texts = allowed.join(details.select("feed", "id", "detail"), ["feed", "id"])
    chosen = unknown.select("feed", "pos", "id").join(texts, ["feed", "id"]).select("feed", "pos", "detail")
    return (
        rows.join(chosen, ["feed", "pos"], "left")
        .withColumn("description", F.coalesce(F.nullif("detail", F.lit("")), F.col("description")))
        .drop("detail")
    )


def site_label(report: DataFrame) -> DataFrame:
    """``jobindex_cli`` reads as ``jobindex`` unless both routes are active."""
    browser = report.filter("source = 'jobindex'").limit(1).agg(F.count("*").alias("n")).scalar()
    shown = F.when((F.col("source") == "jobindex_cli") & (browser == 0), F.lit("jobindex"))
    return report.withColumn("label", shown.otherwise(F.col("source")))


def unknown_sites(searches: DataFrame, known: list[str]) -> DataFrame:
    """Site names asked for that no feed handles, distinct and sorted."""
    default = F.array(*[F.lit(s) for s in fixed.DEFAULT_SITES])
    asked = F.when(F.size("sites") > 0, F.col("sites")).otherwise(default)
    names = searches.select(F.explode(asked).alias("site")).select(
        F.lower(F.btrim("site")).alias("site")
    )
    return names.filter(~F.col("site").isin(*known)).distinct().orderBy("site")
