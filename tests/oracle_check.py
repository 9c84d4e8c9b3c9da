"""Compare queries with their DuckDB SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty where both agree."""
    ours, rows = frame.columns, [tuple(r) for r in frame.collect()]
    con.execute(sql)
    theirs, found = [c[0] for c in con.description], con.fetchall()
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} and {sorted(theirs)}"
    a, b = bag(ours, rows), bag(theirs, found)
    if a != b:
        return f"{len(rows)} and {len(found)} rows; only ours {list((a - b).items())[:2]}; only theirs {list((b - a).items())[:2]}"
    return ""
