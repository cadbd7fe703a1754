"""Holds a query's rows against DuckDB's for the same tables: same columns, same rows, in any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    return x


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def differences(df, sf_dir: str, sql: str) -> str:
    """Empty if both agree."""
    names, rows = duck(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    ours = Counter(tuple(_value(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    theirs = Counter(tuple(_value(r[i]) for i in at) for r in rows)
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {[*(ours - theirs)][:3]}; only theirs {[*(theirs - ours)][:3]}; columns {order}"
