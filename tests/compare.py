"""Run a query and its SQL counterpart and compare rows regardless of order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql("SET threads = 4")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return repr(0.0 if x == 0 else x)
    if isinstance(x, list):
        return str([_cell(y) for y in x])
    return str(x)


def differences(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """An empty string if both give the same columns and rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())
    rel = (con or duck(sf_dir)).sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in names]
    want = Counter(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
