"""Compares a query with its SQL, row by row, order aside."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    r = c.sql(sql)
    columns = sorted(r.columns)
    at = [r.columns.index(k) for k in columns]
    return columns, sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
