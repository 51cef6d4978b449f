"""Compares a query with its SQL in DuckDB, as sets of rows with columns in the order of their names."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        at = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, bool):
        return x
    if hasattr(x, "replace") and hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return float(x) if isinstance(x, int) else x


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def differences(df, con, sql: str) -> str:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs, ours = rows(names, found.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
