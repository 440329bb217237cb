"""Where the library's queries are registered, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .plans.storage import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def whole(f: Query) -> Query:
    """f, with the scratch tables it makes on the way deleted before it returns."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settled(spark, f.__name__, lambda: f(spark, sf_dir))

    return run


def query(name: str, sql: str | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name. With finish, the table that stays is what the function returns, and
    its rows are made into the result's as they are read (no digest of 64 letters is stored that packed letters give)."""

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        stored = whole(f)
        QUERIES[name] = stored if finish is None else wraps(f)(lambda spark, sf_dir: finish(stored(spark, sf_dir)))
        if sql is not None:
            SQL[name] = sql
        return f if finish is None else wraps(f)(lambda spark, sf_dir: finish(f(spark, sf_dir)))

    return keep
