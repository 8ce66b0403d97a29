"""Runs a query and its SQL and compares schemas' names and all values, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(str, map(canonical, value))) + "]"
    return "null" if value is None else str(value)


def difference(spark_df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    order = sorted(names)
    got = sorted([canonical(r[c]) for c in order] for r in spark_df.collect())
    at = [names.index(c) for c in order]
    expected = sorted([canonical(r[i]) for i in at] for r in want)
    if got == expected:
        return ""
    first = next(((a, b) for a, b in zip(got, expected) if a != b), None)
    return f"{len(got)} rows against {len(expected)}; first difference {first}"
