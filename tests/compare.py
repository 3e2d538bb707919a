"""Rows of a DataFrame against rows of a DuckDB statement, in any order."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


def same(df, c, sql: str) -> None:
    relation = c.sql(sql)
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(x) for x in columns]
    want = sorted(repr([_plain(r[i]) for i in at]) for r in relation.fetchall())
    got = sorted(repr([_plain(r[x]) for x in columns]) for r in df.collect())
    assert got == want
