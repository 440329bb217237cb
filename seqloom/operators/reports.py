"""Report pivots of case results, instants from text, lineages from a chain of sources, and receipts that raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import r6
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import table
from .audits import check_receipts
from .sampling import require


def report_pivots(results: DataFrame) -> DataFrame:
    """(pivot, arm, x, y, value, n) of case results (arm, gap, left, right, bits, matches, rerank_exact, recalled): bits a base and
    accuracy by arm and gap, accuracy by left context and gap, exact reranked cases by gap and right context, recall of
    candidates without right context by gap, and errors by the place within the gap. matches is an array of booleans, a codon each.

    Accuracy is over codons, not over cases; a value without cases has no row. All six come from two grouped passes: one over
    cases with grouping sets, one over codons."""
    right, codons = F.size(F.filter("matches", lambda m: m)), F.size("matches")
    rows = Scratch(results.sparkSession, "results").write(results.withColumns({"good": right, "codons": codons}), "results")
    sums = rows.groupingSets([["arm", "gap"], ["left", "gap"], ["gap", "right"]], "arm", "gap", "left", "right").agg(
        F.grouping_id().alias("set"), F.count("*").alias("n"), F.sum(F.col("bits")).alias("bits"), F.count("bits").alias("scored"), F.sum("good").alias("good"), F.sum("codons").alias("codons"),
        F.count_if(F.col("rerank_exact")).alias("exact"), F.count_if((F.col("right") == 0) & F.col("recalled")).alias("recalled"),
    )
    sums = Scratch(results.sparkSession, "sums").write(sums, "sums")
    none = F.lit(None).cast("string")
    by_arm, by_left, by_right = sums.where("set = 3"), sums.where("set = 9"), sums.where("set = 10")
    text = lambda c: F.col(c).cast("string")

    def pivot(df: DataFrame, name: str, arm: Column, x: Column, y: Column, value: Column, n: str = "n") -> DataFrame:
        return df.select(F.lit(name).alias("pivot"), arm.alias("arm"), x.alias("x"), y.alias("y"), r6(value).alias("value"), F.col(n).cast("long").alias("n")).where(F.col("n") > 0)

    parts = [
        pivot(by_arm, "bits_per_base", text("arm"), text("gap"), none, F.try_divide("bits", F.col("scored")), "scored"),
        pivot(by_arm, "accuracy", text("arm"), text("gap"), none, F.try_divide("good", "codons")),
        pivot(by_left, "left_context", none, text("left"), text("gap"), F.try_divide("good", "codons")),
        pivot(by_right, "rerank", none, text("gap"), text("right"), F.col("exact") / F.col("n")),
        pivot(by_right.where("right = 0"), "recall", none, text("gap"), none, F.col("recalled") / F.col("n")),
    ]
    places = rows.select("arm", F.posexplode("matches").alias("k", "m")).groupBy("arm", "k").agg(F.count("*").alias("n"), F.count_if(~F.col("m")).alias("wrong"))
    parts.append(pivot(places, "error_by_offset", text("arm"), text("k"), none, F.col("wrong") / F.col("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_RESULTS = """r AS (SELECT l_returnflag AS arm, l_linenumber AS gap, l_linestatus AS "left", CAST(l_quantity AS INTEGER) % 3 AS "right", CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount END AS bits,
  list_transform(range(l_linenumber), lambda k: (l_orderkey // (k + 1)) % 3 <> 0) AS matches, l_partkey % 4 = 0 AS rerank_exact, l_suppkey % 2 = 0 AS recalled FROM lineitem),
s AS (SELECT *, len(list_filter(matches, lambda m: m)) AS good, len(matches) AS codons FROM r)"""


@query(
    "A26_report_pivots",
    f"""WITH {_RESULTS}, k AS (SELECT arm, unnest(matches) AS m, unnest(range(len(matches))) AS k FROM r)
    SELECT 'bits_per_base' AS pivot, arm, gap::VARCHAR AS x, NULL::VARCHAR AS y, round(sum(bits) / count(bits), 6) + 0.0 AS value, count(bits) AS n FROM s GROUP BY arm, gap HAVING count(bits) > 0
    UNION ALL SELECT 'accuracy', arm, gap::VARCHAR, NULL, round(sum(good) / sum(codons), 6) + 0.0, count(*) FROM s GROUP BY arm, gap
    UNION ALL SELECT 'left_context', NULL, "left", gap::VARCHAR, round(sum(good) / sum(codons), 6) + 0.0, count(*) FROM s GROUP BY "left", gap
    UNION ALL SELECT 'rerank', NULL, gap::VARCHAR, "right"::VARCHAR, round(count(*) FILTER (rerank_exact) / count(*), 6) + 0.0, count(*) FROM s GROUP BY gap, "right"
    UNION ALL SELECT 'recall', NULL, gap::VARCHAR, NULL, round(count(*) FILTER (recalled) / count(*), 6) + 0.0, count(*) FROM s WHERE "right" = 0 GROUP BY gap
    UNION ALL SELECT 'error_by_offset', arm, k::VARCHAR, NULL, round(count(*) FILTER (NOT m) / count(*), 6) + 0.0, count(*) FROM k GROUP BY arm, k""",
)
def a26_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as case results: flag, number, mode and quantity are arm, gap and contexts."""
    lines = table(spark, sf, "lineitem")
    matches = F.transform(F.sequence(F.lit(1), F.col("l_linenumber").cast("int")), lambda k: F.floor(F.col("l_orderkey") / k) % 3 != 0)
    results = lines.select(
        F.col("l_returnflag").alias("arm"), F.col("l_linenumber").alias("gap"), F.col("l_linestatus").alias("left"), (F.col("l_quantity").cast("int") % 3).alias("right"),
        F.when(F.col("l_linenumber") != 5, F.col("l_discount")).alias("bits"), matches.alias("matches"), (F.col("l_partkey") % 4 == 0).alias("rerank_exact"), (F.col("l_suppkey") % 2 == 0).alias("recalled"),
    )
    return report_pivots(results)


_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def instant(text: Column) -> Column:
    """struct<us, problem>: microseconds since the epoch of an ISO 8601 instant with an explicit zone (Z or an offset). A text
    without a zone, or that is no instant, has a problem; null is `invalid`."""
    shape = F.regexp_extract(text, _ISO, 0) != ""
    zone = F.regexp_extract(text, _ISO, 1)
    at = F.when(shape & (zone != ""), F.try_to_timestamp(F.translate(text, "T", " ")))
    problem = F.when(~F.coalesce(shape, F.lit(False)), "invalid").when(zone == "", "no_zone").when(at.isNull(), "invalid")
    return F.struct(F.when(problem.isNull(), F.unix_micros(at)).alias("us"), problem.alias("problem"))


@query(
    "F37_parsed_instants",
    """WITH e AS (SELECT event_id, event_id % 6 AS k, epoch_us(ts) AS us FROM events)
    SELECT event_id, CASE k WHEN 0 THEN us WHEN 1 THEN us // 1000000 * 1000000 - 7200000000 WHEN 2 THEN us // 1000 * 1000 + 19800000000 END AS us, CASE WHEN k = 3 THEN 'no_zone' WHEN k > 3 THEN 'invalid' END AS problem FROM e""",
)
def f37_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Times of all events, written with Z, two offsets, no zone, an impossible month, and as a number."""
    k, ts = F.col("event_id") % 6, F.col("ts").cast("timestamp_ntz")
    shown = lambda pattern: F.date_format(ts, pattern)
    text = (
        F.when(k == 0, F.concat(shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(k == 1, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))).when(k == 2, F.concat(shown("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-05:30")))
        .when(k == 3, shown("yyyy-MM-dd'T'HH:mm:ss")).when(k == 4, F.concat(shown("yyyy-'13'-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    )
    return table(spark, sf, "events").select("event_id", instant(text).alias("x")).select("event_id", "x.us", "x.problem")


def resolve_lineage(records: DataFrame, sources: list[tuple[str, DataFrame]], fallback: str) -> DataFrame:
    """records (key, ...) with lineage and source: from the first source (key, lineage) in order that knows the key; the fallback,
    as source `fallback`, where none does. A source's repeated keys give its smallest lineage; null lineages are no answer."""
    out = records
    for k, (_, source) in enumerate(sources):
        found = source.where(F.col("lineage").isNotNull()).groupBy("key").agg(F.min("lineage").alias(f"__l{k}"))
        out = out.join(found, "key", "left")
    answers = [F.when(F.col(f"__l{k}").isNotNull(), F.struct(F.col(f"__l{k}").alias("lineage"), F.lit(name).alias("source"))) for k, (name, _) in enumerate(sources)]
    best = F.coalesce(*answers, F.struct(F.lit(fallback).alias("lineage"), F.lit("fallback").alias("source")))
    return out.withColumn("__best", best).select(*records.columns, "__best.lineage", "__best.source")


@query(
    "P14_lineage_chain",
    """WITH n AS (SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, CASE WHEN k % 4 = 0 THEN 'cached: ' || n_name WHEN k % 3 = 0 THEN r_name || ' > ' || n_name WHEN k < 15 THEN r_name ELSE 'unclassified' END AS lineage,
      CASE WHEN k % 4 = 0 THEN 'cache' WHEN k % 3 = 0 THEN 'registry' WHEN k < 15 THEN 'static' ELSE 'fallback' END AS source FROM customer LEFT JOIN n ON k = c_nationkey""",
)
def p14_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' nations: a cache knows some, a registry others, a static table the region of some more."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").alias("key")
    cache = nations.where("n_nationkey % 4 = 0").select(key, F.concat(F.lit("cached: "), "n_name").alias("lineage"))
    registry = nations.where("n_nationkey % 3 = 0").select(key, F.concat_ws(" > ", "r_name", "n_name").alias("lineage"))
    static = nations.where("n_nationkey < 15").select(key, F.col("r_name").alias("lineage"))
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    return resolve_lineage(customers, [("cache", cache), ("registry", registry), ("static", static)], "unclassified").drop("key")


def require_receipts(receipts: DataFrame, actual: DataFrame, name: str, digest: str) -> DataFrame:
    """actual, or ValueError naming the first bad state and one example: a receipt whose digest differs (drift), whose item is
    missing, or an item without a receipt (unlisted). Identity is checked before anything is used."""
    bad = check_receipts(receipts, actual, name, digest).where("state <> 'ok'").groupBy("state").agg(F.count("*").alias("n"), F.min(name).alias("example")).orderBy("state").limit(1).collect()
    require([(f"receipts: {r.state} ({r.n}, such as {r.example})", False) for r in bad])
    return actual
