"""Comparison of a query's rows with those of its SQL twin in DuckDB."""

import math
import os
from collections import Counter

import duckdb


def connect(d):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(d):
        path = f"{d}/{f}/*.parquet" if os.path.isdir(f"{d}/{f}") else f"{d}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    """NaN equals nothing, itself included, so that a result that holds one never passes."""
    if isinstance(v, float):
        return object() if math.isnan(v) else round(v, 6)
    return v


def compare(df, sql, con):
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns, (names, columns)
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want, f"{sum(got.values())} rows, want {sum(want.values())}; more {list((got - want).items())[:3]}, missing {list((want - got).items())[:3]}"
