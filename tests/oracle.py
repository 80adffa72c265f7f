"""Compare a query's rows with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb

from tidelog.plans.views import TABLES


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(table):
    cols = sorted(table.column_names)
    return sorted((tuple(norm(r[c]) for c in cols) for r in table.to_pylist()), key=repr)


def connect(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def same(spark, sf, query, sql):
    got, want = query(spark, sf).toArrow(), connect(sf).sql(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
