"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message, seconds in Spark, seconds in SQL)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)}", t1 - t0, 0.0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", t1 - t0, t2 - t1
    a, b = _rows(df.columns, got), _rows(cols, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}", t1 - t0, t2 - t1
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return False, f"{len(diff)} of {len(a)} rows differ, first {diff[0]}", t1 - t0, t2 - t1
    return True, f"rows {len(a)}", t1 - t0, t2 - t1
