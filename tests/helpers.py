"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path + '/**/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_value(r[i]) for i in order]) for r in data)


def same(query, sql: str, spark, folder: str) -> None:
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(folder).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want
