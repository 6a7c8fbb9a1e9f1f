"""Compares a query with its SQL, as the driver does."""

from __future__ import annotations

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def rows(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(sql: str, sf: str = SF, con=None) -> list[tuple]:
    r = (con or connect(sf)).sql(sql)
    columns = r.columns
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(row[k]) for k in order) for row in r.fetchall())
