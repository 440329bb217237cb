"""Start and stop rows paired in order, and checks of the windows they make, by places and running maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import positions, table


def running_max(df: DataFrame, group: list[str], bucket: F.Column, order: list[str], value: str, out: str) -> DataFrame:
    """df with the largest value in the rows of its group before each row (null before the first).

    bucket must not fall along the order. Rows look back within their bucket only; the buckets' maxima are looked up over the
    group, so a hot group is never sorted in one task. Groups hold no nulls."""
    rows = df.withColumn("__b", bucket)
    most = rows.groupBy(*group, "__b").agg(F.max(value).alias("__m"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    most = most.select(*group, "__b", F.max("__m").over(before).alias("__before"))
    inside = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.max(value).over(inside)).join(most, [*group, "__b"])
    return rows.select(*df.columns, F.greatest("__before", "__in").alias(out))


#: Checks of a window in their order.
CHECKS = ("unpaired", "wrong_kinds", "other_scenario", "not_after_previous", "not_positive", "out_of_bounds", "invalid_residency", "residency_disagrees")


def paired_windows(events: DataFrame, starts: list[str], stops: list[str], bounds: DataFrame, tolerance_us: int = 0) -> DataFrame:
    """(user_id, pair, first_id, began, ended, duration_us, idle_us, problem): rows of a user in order of event_id, two by two.

    events: user_id, event_id, us (time in microseconds), kind, scenario, idle_us (reported by the stop). bounds: (user_id, low,
    high), within which windows lie. problem is the first of CHECKS that a window fails: a last row without a partner, kinds
    that are no start and stop, two scenarios, a start before an earlier window's end, an end not after the start, a window out
    of bounds, idle time that is null or not positive, or longer than the window and the tolerance. Windows that fail count
    as earlier ones all the same. Null users, ids and times take no part; a user without bounds has all windows out of them."""
    scratch = Scratch(events.sparkSession, "windows")
    known = events.where("user_id IS NOT NULL AND event_id IS NOT NULL AND us IS NOT NULL")
    placed = positions(known, ["user_id"], F.expr("event_id div 1000"), ["event_id", "us"])
    row = F.struct("event_id", "us", "kind", "scenario", "idle_us")
    sided = placed.groupBy("user_id", F.expr("pos div 2").alias("pair")).agg(F.max(F.when(F.col("pos") % 2 == 0, row)).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, row)).alias("b"))
    pairs = sided.select("user_id", "pair", F.col("a.event_id").alias("first_id"), F.col("a.us").alias("began"), F.col("b.us").alias("ended"), F.col("a.kind").alias("k1"), F.col("b.kind").alias("k2"), F.col("a.scenario").alias("s1"), F.col("b.scenario").alias("s2"), F.col("b.idle_us").alias("idle_us"))
    pairs = scratch.write(pairs, "pairs")
    rows = running_max(pairs, ["user_id"], F.expr("first_id div 1000"), ["pair"], "ended", "latest").join(bounds.select("user_id", "low", "high"), "user_id", "left")
    length = F.col("ended") - F.col("began")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = [
        F.col("ended").isNull(), no(F.col("k1").isin(starts) & F.col("k2").isin(stops)), ~F.col("s1").eqNullSafe(F.col("s2")), F.coalesce(F.col("began") < F.col("latest"), F.lit(False)), length <= 0,
        no((F.col("began") >= F.col("low")) & (F.col("ended") <= F.col("high"))), no(F.col("idle_us") > 0), F.col("idle_us") > length + tolerance_us,
    ]
    problem = F.coalesce(*[F.when(bad, name) for name, bad in zip(CHECKS, rules, strict=True)])
    return rows.select("user_id", "pair", "first_id", "began", "ended", length.alias("duration_us"), "idle_us", problem.alias("problem"))


STARTS, STOPS = ["view", "click", "signup"], ["purchase", "click", "view", "signup"]


@query(
    "W18_paired_windows",
    f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) - CASE WHEN event_id % 37 = 0 THEN 259200000000 ELSE 0 END AS us, event_type AS kind, event_id % 16 = 0 AS scenario, CAST(floor(value * 6e7) AS BIGINT) - 600000000 AS idle_us FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, us) - 1 AS pos FROM e),
    p AS (SELECT a.user_id, a.pos // 2 AS pair, a.event_id AS first_id, a.us AS began, b.us AS ended, a.kind AS k1, b.kind AS k2, a.scenario AS s1, b.scenario AS s2, b.idle_us
      FROM o a LEFT JOIN o b ON b.user_id = a.user_id AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0),
    r AS (SELECT *, max(ended) OVER (PARTITION BY user_id ORDER BY pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM p),
    b AS (SELECT user_id, min(epoch_us(ts)) + 3600000000 AS low, max(epoch_us(ts)) - 3600000000 AS high FROM events GROUP BY user_id),
    c AS (SELECT r.*, ended - began AS d, CASE WHEN ended IS NULL THEN 'unpaired' WHEN NOT (k1 IN ('{"', '".join(STARTS)}') AND k2 IN ('{"', '".join(STOPS)}')) THEN 'wrong_kinds' WHEN s1 <> s2 THEN 'other_scenario' WHEN began < latest THEN 'not_after_previous'
      WHEN ended <= began THEN 'not_positive' WHEN began < low OR ended > high THEN 'out_of_bounds' WHEN idle_us IS NULL OR idle_us <= 0 THEN 'invalid_residency' WHEN idle_us > ended - began + 1000000 THEN 'residency_disagrees' END AS problem FROM r JOIN b USING (user_id))
    SELECT problem, count(*) AS n, count(DISTINCT user_id) AS n_users, min(first_id) AS first_id, CAST(coalesce(sum(CASE WHEN problem IS NULL THEN idle_us END), 0) AS BIGINT) AS credited_us FROM c GROUP BY problem""",
)
def w18_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as starts and stops in order of their ids; every kind of problem, and the idle time that valid windows credit."""
    events = table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    us = at - F.when(F.col("event_id") % 37 == 0, 259_200_000_000).otherwise(0)  # planted: some clocks are three days late
    rows = events.select("user_id", "event_id", at.alias("at"), us.alias("us"), F.col("event_type").alias("kind"), (F.col("event_id") % 16 == 0).alias("scenario"), (F.floor(F.col("value") * 6e7).cast("long") - 600_000_000).alias("idle_us"))
    rows = Scratch(spark, "events").write(rows, "rows")
    hour = 3_600_000_000
    bounds = rows.groupBy("user_id").agg((F.min("at") + hour).alias("low"), (F.max("at") - hour).alias("high"))
    found = paired_windows(rows, STARTS, STOPS, bounds, 1_000_000)
    credit = F.coalesce(F.sum(F.when(F.col("problem").isNull(), F.col("idle_us"))), F.lit(0))
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.min("first_id").alias("first_id"), credit.alias("credited_us"))
