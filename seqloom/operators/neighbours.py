"""Identities, edit distances and nearest neighbours over fragments of whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import CDS_SQL, cds
from .alignment import sequence_identity
from .near_pairs import digest, near_pairs, packed_fragments
from .similarity import FRAGMENT, REPORT, _bound, _pairs_sql, cohort_counts


def nearest_known(rows: DataFrame, least: float) -> DataFrame:
    """(n, p, nearest, differences) of each distinct holdout sequence (packed: cohort, n, p): the training sequence of equal length with the
    fewest differences, ties to the smaller digest, if one has an identity of `least` or more, else null.

    A sequence that training has is its own nearest. The pair search loses none, so nulls are sure; copies count once."""
    scratch = Scratch(rows.sparkSession, "nearest")
    nodes = scratch.write(cohort_counts(rows), "nodes")
    near = near_pairs(nodes, _bound(least), [], scratch, cross=True)
    found = lambda d, s, q: F.struct(d.alias("differences"), s.alias("s"), q.alias("q"))
    way = lambda a, b: F.when((F.col(f"h{a}") > 0) & (F.col(f"t{a}") == 0) & (F.col(f"t{b}") > 0), F.struct(F.col(a).alias("p"), F.col(b).alias("q")))
    pairs = near.select("n", "differences", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).where("w IS NOT NULL").select("n", "w.p", "differences", "w.q")
    pairs = pairs.select("n", "p", found(F.col("differences"), digest(F.col("q"), F.col("n")), F.col("q")).alias("m"))
    asked = nodes.where("h > 0").select("n", "p", F.when(F.col("t") > 0, found(F.lit(0), F.lit(""), F.col("p"))).alias("m"))
    best = asked.unionByName(pairs).groupBy("n", "p").agg(F.min("m").alias("m"))
    return best.select("n", "p", F.col("m.q").alias("nearest"), F.col("m.differences").cast("long").alias("differences"))


def with_nearest(rows: DataFrame) -> DataFrame:
    return rows.select(digest(F.col("p"), F.col("n")).alias("sequence_sha256"), digest(F.col("nearest"), F.col("n")).alias("nearest"), "differences")


@query(
    "J10_nearest_training",
    f"""WITH {_pairs_sql(REPORT, FRAGMENT, False)}, tr AS (SELECT DISTINCT sequence_sha256 AS t FROM frag WHERE cohort = 'training'), ho AS (SELECT DISTINCT sequence_sha256 FROM frag WHERE cohort = 'holdout'),
    e AS (SELECT a, b, differences FROM pair UNION ALL SELECT b, a, differences FROM pair UNION ALL SELECT t, t, 0 FROM tr), best AS (SELECT a, min(differences) AS d, arg_min(b, (differences, b)) AS n FROM e JOIN tr ON t = b GROUP BY a)
    SELECT sequence_sha256, n AS nearest, CAST(d AS BIGINT) AS differences FROM ho LEFT JOIN best ON a = sequence_sha256""",
    with_nearest,
)
def j10_training(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_known(packed_fragments(spark, sf, FRAGMENT, "cohort"), REPORT)


_RUNS = f"""{CDS_SQL}, rn AS (SELECT doc_id, unnest(regexp_extract_all(rna, '.{{{FRAGMENT}}}')) AS rna, unnest(range(length(rna) // {FRAGMENT})) AS k FROM cds)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.regexp_extract_all("rna", F.lit(f".{{{FRAGMENT}}}"), F.lit(0))
    return cds(spark, sf).select("doc_id", F.posexplode(pieces).alias("k", "rna"))


@query(
    "F11_F12_fragment_distances",
    f"WITH {_RUNS} SELECT a.doc_id, a.k, levenshtein(a.rna, b.rna) AS distance FROM rn a JOIN rn b ON b.doc_id = a.doc_id AND b.k = a.k + 1",
)
def f11_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Each fragment of a record and the one behind it: they meet in the record's own row, so nothing moves."""
    pieces = F.regexp_extract_all("rna", F.lit(f".{{{FRAGMENT}}}"), F.lit(0))
    rows = cds(spark, sf).select("doc_id", pieces.alias("p"))
    both = F.arrays_zip(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))).alias("a"), F.slice("p", F.lit(2), F.size("p")).alias("b"))
    rows = rows.select("doc_id", F.posexplode(both).alias("k", "x"))
    return rows.select("doc_id", "k", F.levenshtein("x.a", "x.b").cast("long").alias("distance"))


@query(
    "F14_fragment_identity",
    f"""WITH {_RUNS}, v AS (SELECT DISTINCT rna, ('0x' || substr(sha256(rna), 1, 4))::INTEGER AS h FROM rn)
    SELECT sha256(rna) AS sequence_sha256, CASE h % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'changed' ELSE 'shorter' END AS kind,
      round(CASE h % 3 WHEN 0 THEN 1.0 WHEN 1 THEN {FRAGMENT - 1} / {FRAGMENT} ELSE {FRAGMENT - 3} / {FRAGMENT} END, 6) + 0.0 AS identity FROM v""",
)
def f14_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct fragment and a variant of it: itself, with one base changed, or with one codon taken out at a place by hash.

    The SQL knows what was done. A codon taken out leaves n - 3 places that can agree, and no other alignment scores as well."""
    rows = Scratch(spark, "fragments").write(_runs(spark, sf).select("rna").distinct(), "distinct")
    digest = F.sha2("rna", 256)
    h = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    at = F.expr(f"cast(conv(substring(sha2(rna, 256), 5, 4), 16, 10) as int) % {FRAGMENT // 3}")
    rows = rows.withColumns({"sequence_sha256": digest, "h": h, "at": at})
    other = F.translate(F.substring("rna", F.col("at") + 1, F.lit(1)), "ACGU", "CGUA")
    variant = F.when(F.col("h") % 3 == 0, F.col("rna")).when(F.col("h") % 3 == 1, F.overlay("rna", other, F.col("at") + 1)).otherwise(F.concat(F.substring("rna", F.lit(1), 3 * F.col("at")), F.substring("rna", 3 * F.col("at") + 4, F.lit(FRAGMENT))))
    kind = F.when(F.col("h") % 3 == 0, "same").when(F.col("h") % 3 == 1, "changed").otherwise("shorter")
    return sequence_identity(rows.withColumns({"variant": variant, "kind": kind}), "rna", "variant", "identity").select("sequence_sha256", "kind", "identity")
