"""Compares a query with its SQL in DuckDB, whatever the order of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if type(v).__name__ == "Decimal":
        v = float(v)
    return repr(round(float(v), 5)) if isinstance(v, (int, float)) else str(v)


def same(df, sql: str, c: duckdb.DuckDBPyConnection) -> None:
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    found = c.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall())
    assert got == want
