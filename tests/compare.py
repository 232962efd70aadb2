"""Holds registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return str(x) if not isinstance(x, (int, str)) else x


def difference(con, sql: str, df) -> str:
    """Empty if rows and columns agree."""
    rel = con.sql(sql)
    names, rows = sorted(df.columns), df.collect()
    if names != sorted(rel.columns):
        return f"columns {names} {sorted(rel.columns)}"
    want = Counter(tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    got = Counter(tuple(plain(r[c]) for c in names) for r in rows)
    if want != got:
        return f"{sum(got.values())} rows, {sum(want.values())} wanted; only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"
    return "" if rows else "no rows"
