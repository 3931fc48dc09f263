"""Rows of a Spark query and of its DuckDB SQL, in a form that can be compared."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    want = sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
