"""Comparison of a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import os

import duckdb


def views(folder: str):
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(v) -> str:
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v) if isinstance(v, float) else str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def assert_same(df, connection, sql: str) -> None:
    found = connection.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
