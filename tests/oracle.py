"""Rows of a query and of its SQL in a form that can be compared."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x: object) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def spark_rows(df) -> tuple[list[str], list[tuple[str, ...]]]:
    return sorted(df.columns), sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sql: str, sf: str) -> tuple[list[str], list[tuple[str, ...]]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(names), sorted_rows(names, found.fetchall())
