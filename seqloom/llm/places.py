"""Places of rows in an order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import Scratch

_PART, _TIE, _FROM = "__part", "__tie", "__from"


def places(df: DataFrame, group: list[str], order: list[str], scratch: Scratch, name: str, weight: str | None = None) -> DataFrame:
    """df with place (long): the rows (or the sum of a long column weight) before each row of its group in the order.

    Rows are dealt to ranges of (group, order), so a group of any size spreads over tasks, and equal rows do too: a last
    key, the row's number in the input, tells them apart. Within a range rows are numbered by a window; only the ranges'
    totals are added up over a group. Group columns hold no nulls; nulls come first in the order; an empty table gives
    an empty one. The dealt rows are written, so that a lost executor cannot deal them again in another way."""
    keys = [*group, *order, _TIE]
    dealt = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn(_PART, F.spark_partition_id())
    dealt = scratch.write(dealt, name)
    one = F.col(weight) if weight else F.lit(1).cast("long")
    totals = dealt.groupBy(*group, _PART).agg(F.sum(one).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*group, _PART, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(_FROM))
    inside = Window.partitionBy(*group, _PART).orderBy(*order, _TIE).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("__in", F.coalesce(F.sum(one).over(inside), F.lit(0)))
    return rows.join(start, [*group, _PART]).select(*df.columns, (F.col(_FROM) + F.col("__in")).alias("place"))
