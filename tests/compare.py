"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return f"{type(value).__name__} {value}"


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    got = query(spark, sf_dir)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    ours = rows_of(got.columns, got.collect())
    theirs = rows_of(names, cursor.fetchall())
    if ours == theirs:
        return ""
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours "
        f"{sum(only_ours.values())}: {list(only_ours)[:2]}; only SQL "
        f"{sum(only_theirs.values())}: {list(only_theirs)[:2]}"
    )
