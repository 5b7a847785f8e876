"""Schema-less feed items (JSON) mapped onto posting fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.functions import fixed
from postsift.functions import text as tx

_EMPTY = ("null", '""', "[]", "{}")
_FALSY = _EMPTY + ("false", "0", "0.0")


def _given(value: Column, empty=_EMPTY) -> Column:
    return value.isNotNull() & ~F.coalesce(F.to_json(value), F.lit("null")).isin(*empty)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _key(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _unwrap(value: Column) -> Column:
    """An object stands for its first truthy naming key; anything else for itself."""
    named = F.lit(None).cast("variant")
    for key in reversed(fixed.NAME_KEYS):
        child = _key(value, key)
        named = F.when(_given(child, _FALSY), child).otherwise(named)
    return F.when(_kind(value).startswith("OBJECT"), named).otherwise(value)


def _scalar(value: Column) -> Column:
    kind = _kind(value)
    plain = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    return (
        F.when(kind == "STRING", F.btrim(plain))
        .when(kind == "BOOLEAN", F.when(plain == "true", F.lit("yes")).otherwise(F.lit("")))
        .when(kind.rlike("^(OBJECT|ARRAY|VOID)"), F.lit(""))
        .otherwise(plain)
    )


def _unwrap_twice(value: Column, body) -> Column:
    return tx.let(value, lambda v: tx.let(_unwrap(v), lambda w: tx.let(_unwrap(w), body)))


def _text_parts(value: Column) -> Column:
    """(text, deep): the value as text, and what is nested too deep for that as JSON, else null."""

    def nested(e: Column) -> Column:
        return _unwrap_twice(e, lambda u: _kind(u).rlike("^(OBJECT|ARRAY)"))

    def shown(v: Column) -> Column:
        listed = _kind(v).startswith("ARRAY")
        elements = F.try_variant_get(v, "$", "array<variant>")
        parts = F.filter(F.transform(elements, lambda e: _unwrap_twice(e, _scalar)), lambda p: p != "")
        deep = F.when(listed, F.exists(elements, nested)).otherwise(_kind(v).startswith("OBJECT"))
        return F.struct(
            F.when(listed, F.array_join(parts, ", ")).otherwise(_scalar(v)).alias("text"),
            F.when(deep, F.to_json(v)).alias("deep"))

    return _unwrap_twice(value, shown)


def _plain(value) -> str:
    if isinstance(value, dict):
        return _plain(next((v for v in map(value.get, fixed.NAME_KEYS) if v), ""))
    if isinstance(value, list):
        return ", ".join(filter(None, map(_plain, value)))
    if isinstance(value, bool) or value is None:
        return "yes" if value else ""
    return str(value).strip()


@F.pandas_udf(T.StringType())
def _deep_text(values: pd.Series) -> pd.Series:
    """Columns have no recursion: values nested deeper than two objects or lists are read here."""
    return values.map(lambda v: _plain(json.loads(v)), na_action="ignore")


def _joined(parts: Column) -> Column:
    return F.coalesce(_deep_text(parts["deep"]), parts["text"], F.lit(""))


def as_text(value: Column) -> Column:
    """Any JSON value as plain text; objects stand for their first naming key, lists for their parts, at any depth."""
    return _joined(_text_parts(value))


def first_present(item: Column, keys) -> Column:
    """The first key holding something other than null, '', [] or {}."""
    out = F.lit(None).cast("variant")
    for key in reversed(list(keys)):
        child = _key(item, key)
        out = F.when(_given(child), child).otherwise(out)
    return out


def merge_aliases(field_map: dict[str, str] | None = None) -> dict[str, tuple[str, ...]]:
    """The alias table with per-feed overrides put in front."""
    aliases = dict(fixed.FIELD_ALIASES)
    for name, key in (field_map or {}).items():
        if name in aliases and key:
            aliases[name] = (str(key), *aliases[name])
    return aliases


def map_alias(
    items: DataFrame,
    site: str,
    term: Column,
    field_map: dict[str, str] | None = None,
    raw: str = "raw",
) -> DataFrame:
    """Posting rows from a JSON text column; other columns are kept."""
    aliases = merge_aliases(field_map)

    def remote(value: Column) -> Column:
        flag = F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        return F.struct(flag.alias("flag"), _text_parts(value).alias("words"))

    def read(item: Column) -> Column:
        texts = [_text_parts(first_present(item, k)).alias(n) for n, k in aliases.items() if n != "is_remote"]
        return F.struct(*texts, tx.let(first_present(item, aliases["is_remote"]), remote).alias("remote"))

    kept = [c for c in items.columns if c != raw]
    # The text is parsed once per row; every field reads the parsed value.
    fields = items.select(*kept, tx.let(F.try_parse_json(raw), read).alias("f"))
    plain = [n for n in aliases if n not in ("description", "date_posted", "is_remote")]
    said = F.lower(F.concat_ws(" ", _joined(F.col("f.remote.words")), _joined(F.col("f.location"))))
    return fields.select(
        *kept,
        *[_joined(F.col(f"f.{n}")).alias(n) for n in plain],
        tx.strip_tags_inline(_joined(F.col("f.description"))).alias("description"),
        tx.iso_date_prefix(_joined(F.col("f.date_posted"))).alias("date_posted"),
        F.coalesce(F.col("f.remote.flag"), said.contains("remote")).alias("is_remote"),
        F.lit(site).alias("site"),
        term.alias("search_term"),
    )


def render_text(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` in one pass. Inserted text is never looked at again, and
    unknown names stay as they are: the template is cut up front into literals
    and columns, so there is nothing to substitute twice."""
    parts, at = [], 0
    for found in re.finditer(r"\{(\w+)\}", template):
        if found[1] not in values:
            continue
        if found.start() > at:
            parts.append(F.lit(template[at:found.start()]))
        parts.append(tx.text_or_empty(values[found[1]].cast("string")))
        at = found.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def render_template(template, values: dict[str, Column]) -> Column:
    """The template filled in, recursively. A value that is exactly one
    placeholder keeps the type of its column; dicts become structs."""
    if isinstance(template, dict):
        return F.struct(*[render_template(v, values).alias(k) for k, v in template.items()])
    if isinstance(template, list):
        return F.array(*[render_template(v, values) for v in template])
    if isinstance(template, str):
        whole = re.fullmatch(r"\{(\w+)\}", template.strip())
        if whole and whole[1] in values:
            return values[whole[1]]
        return render_text(template, values)
    return F.lit(template)
