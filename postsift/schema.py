"""The row shapes every operator agrees on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TEXT_FIELDS = (
    "title", "company", "location", "description", "url", "site",
    "date_posted", "salary", "job_type",
)

#: One posting. Missing text is the empty string, never null.
POSTING = T.StructType(
    [T.StructField(name, T.StringType()) for name in _TEXT_FIELDS]
    + [T.StructField("is_remote", T.BooleanType()), T.StructField("search_term", T.StringType())]
)

#: The scorer's answer about one posting.
VERDICT = T.StructType([
    T.StructField("score", T.StringType()),
    T.StructField("language_barrier", T.BooleanType()),
    T.StructField("work_authorization_barrier", T.BooleanType()),
    T.StructField("seniority_match", T.StringType()),
    T.StructField("key_matches", T.ArrayType(T.StringType())),
    T.StructField("gaps", T.ArrayType(T.StringType())),
    T.StructField("reasoning", T.StringType()),
])

#: The history table, partitioned by ``first_seen`` on disk.
SEEN = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("first_seen", T.DateType()),
    T.StructField("date_posted", T.StringType()),
    T.StructField("search_term", T.StringType()),
    T.StructField("verdict_json", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("desc_head", T.StringType()),
])


@dataclass(frozen=True)
class Rules:
    """The filter rules of one profile."""

    extra_keywords: tuple[str, ...] = ()
    extra_stop_words: tuple[str, ...] = ()
    exclude_titles: tuple[str, ...] = ()
    exclude_locations: tuple[str, ...] = ()
    keep_locations: tuple[str, ...] = ()
    whole_word: bool = False
    use_prefilter: bool = True


@dataclass(frozen=True)
class Family:
    """A kind of role, recognised by words or phrases in a title."""

    name: str
    terms: tuple[str, ...] = field(default_factory=tuple)
    require_all: bool = False
