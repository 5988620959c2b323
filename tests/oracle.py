"""Holds a query against its SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import math
import os
from collections import Counter
from glob import glob

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x.isoformat() if hasattr(x, "isoformat") else x


def spark_rows(df) -> Counter:
    cols = sorted(df.columns)
    return Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def compare(df, con, sql: str) -> str:
    """Empty if equal, otherwise what differs."""
    names, want = sql_rows(con, sql)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    got = spark_rows(df)
    if got == want:
        return ""
    return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {list((got - want).items())[:3]}, only SQL {list((want - got).items())[:3]}"
