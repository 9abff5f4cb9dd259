"""Runs a registered query and its SQL twin and compares them as sorted rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__ in ("int", "float")), repr(float(x)) if isinstance(x, (int, float)) else repr(x)) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, sf_dir, query, twin) -> str | None:
    """None when equal, else a short text about the difference."""
    df = query(spark, sf_dir)
    left_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(twin)
    names = [d[0] for d in cur.description]
    right_rows = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, left_rows), rows_of(names, right_rows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:2]} / {b[:2]}"
    if not a:
        return "both empty"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ {sorted(names)}\n   {bad[0][0]}\n   {bad[0][1]}"
    return None
