"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _cell(v)) for k, v in value.items()))
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return repr(value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    cols = sorted(spark_df.columns)
    got = _sorted(tuple(_cell(r[c]) for c in cols) for r in spark_df.collect())
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != cols:
        return [f"columns {cols} != {sorted(names)}"]
    types = dict(zip(names, (str(t) for t in rel.types)))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
    out = []
    for f in spark_df.schema.fields:
        want = same.get(f.dataType.simpleString())
        if want and want != types[f.name]:
            out.append(f"type of {f.name}: spark {f.dataType.simpleString()} vs {types[f.name]}")
    order = [names.index(c) for c in cols]
    want = _sorted(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        for label, only in (("spark only", g - w), ("sql only", w - g)):
            for row in sorted(only)[:3]:
                out.append(f"{label}: {row[:600]}")
        out.append(f"cols {cols}")
    return out
