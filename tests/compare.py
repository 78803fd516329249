"""Compares a query with its SQL: same columns, same rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    """A value as the comparison sees it: floats to nine digits, lists as tuples."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return float(value) if type(value).__name__ == "Decimal" else value


def duck_rows(sql: str, folder: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(row[i]) for i in order) for row in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in row) for row in df.select(*names).collect())


def difference(df, sql: str, folder: str) -> str:
    """Empty if both give the same rows, else what differs."""
    (names, mine), (others, theirs) = spark_rows(df), duck_rows(sql, folder)
    if names != others:
        return f"columns {names} against {others}"
    more, less = mine - theirs, theirs - mine
    return "" if not more and not less else f"{sum(more.values())} rows too many, {sum(less.values())} missing: {list(more)[:2]} / {list(less)[:2]}"
