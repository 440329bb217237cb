"""Joins with small key sets: broadcast behind a check of the size, a shuffle beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few words each up to which a side is broadcast (about 16 MB).
BROADCAST_ROWS = 500_000


def keep_keys(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with keys, which should be cheap to count (a written table). The count stops at the limit."""
    small = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys, on, how)
