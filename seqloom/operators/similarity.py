"""Similar sequences: equal-length pairs within a bound of differences, their components, and audits.

Pairs are found by pigeonhole: a pair with at most d differences agrees on r at least of d + r pieces, so nothing is compared
with everything (near_pairs). Only distinct sequences take part; copies share their sequence's cluster. Fragments travel packed,
and digests are made where a result is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import r6
from ..plans.graph import connected_components
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import fragments_sql, table
from .near_pairs import MANY, digest, near_pairs, packed, packed_fragments, planes_of

BLOCK = ["family", "taxon"]
#: Bases of the fragments that whole records are cut into, so that many have equal lengths.
FRAGMENT = 48
#: Bases of G1's runs, which cover records to their last base.
RUN = 24
THRESHOLDS, REPORT = (0.99, 0.95, 0.9), 0.8


def _bound(threshold: float) -> Callable[[Column], Column]:
    return lambda n: F.floor((1 - threshold) * n + 1e-10).cast("int")


def similar_pairs(records: DataFrame, threshold: float, block: list[str] = BLOCK) -> DataFrame:
    """(block, n, a, b, differences): distinct sequences of equal length n whose share of equal places is
    threshold or more, a < b. Sequences go by their sequence_sha256, whatever that is."""
    scratch, planes = Scratch(records.sparkSession, "similar"), planes_of(records)
    unique = packed(records, *block, "sequence_sha256", planes=planes).groupBy(*block, "sequence_sha256").agg(F.first(F.struct("n", "p")).alias("x")).select(*block, "sequence_sha256", "x.*")
    unique = scratch.write(unique, "unique")
    near = near_pairs(unique.select(*block, "n", "p").distinct(), _bound(threshold), block, scratch, planes)
    side = lambda x, y: unique.select(*block, "n", F.col("p").alias(x), F.col("sequence_sha256").alias(y))
    rows = near.join(side("a", "sa"), [*block, "n", "a"]).join(side("b", "sb"), [*block, "n", "b"])
    return rows.select(*block, "n", F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"), "differences")


def fragment_pairs(spark: SparkSession, sf: str, threshold: float, block: list[str]) -> DataFrame:
    """(block, n, a, b, differences): similar_pairs() of fragments, packed and in no order."""
    scratch = Scratch(spark, "similar")
    rows = scratch.write(packed_fragments(spark, sf, FRAGMENT, *block).distinct(), "distinct")
    return near_pairs(rows, _bound(threshold), block, scratch).drop("c")


def with_digests(pairs: DataFrame) -> DataFrame:
    """Packed pairs by digests, the smaller first."""
    a, b = digest(F.col("a"), F.col("n")), digest(F.col("b"), F.col("n"))
    return pairs.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})


def _pairs_sql(threshold: float, width: int, block: bool = True) -> str:
    """CTEs u and pair: candidates share a piece of one more than the allowed differences, found by another cut than ours."""
    k = int((1 - threshold) * width + 1e-10) + 1
    same, by = ("a.family = b.family AND a.taxon = b.taxon AND ", "family, taxon, ") if block else ("", "")
    of = "a.family, a.taxon, " if block else ""
    return f"""{fragments_sql(width)}, u AS (SELECT DISTINCT {by}sequence_sha256, rna, length(rna) AS n FROM frag),
seg AS (SELECT *, substr(rna, CAST(i * {width} // {k} AS INTEGER) + 1, CAST((i + 1) * {width} // {k} - i * {width} // {k} AS INTEGER)) AS piece FROM (SELECT *, unnest(range({k})) AS i FROM u)),
pair AS (SELECT DISTINCT {of}a.n, a.sequence_sha256 AS a, b.sequence_sha256 AS b, hamming(a.rna, b.rna) AS differences
  FROM seg a JOIN seg b ON {same}a.i = b.i AND a.piece = b.piece AND a.sequence_sha256 < b.sequence_sha256 WHERE hamming(a.rna, b.rna) < {k})"""


_PAIRS = _pairs_sql(0.9, FRAGMENT)


@query("J8_blocked_pairs", f"WITH {_PAIRS} SELECT * FROM pair", with_digests)
def j8(spark: SparkSession, sf: str) -> DataFrame:
    return fragment_pairs(spark, sf, 0.9, BLOCK)


@query("J9_cross_stratum_pairs", f"WITH {_pairs_sql(REPORT, FRAGMENT, False)} SELECT * FROM pair", with_digests)
def j9(spark: SparkSession, sf: str) -> DataFrame:
    """Over all strata, from the identity that is reported on."""
    return fragment_pairs(spark, sf, REPORT, [])


def nearest(queries: DataFrame, targets: DataFrame, block: str) -> DataFrame:
    """(block, q, t, distance): each distinct query string's nearest target of its block by edit distance,
    ties to the smaller string. Meant for short strings with few distinct values a block."""
    q = queries.select(block, "q").distinct()
    t = targets.select(block, "t").distinct()
    pairs = q.join(t, block).withColumn("d", F.levenshtein("q", "t"))
    return pairs.groupBy(block, "q").agg(F.min(F.struct("d", "t")).alias("m")).select(block, "q", F.col("m.t").alias("t"), F.col("m.d").alias("distance"))


@query(
    "J10_nearest_neighbour",
    """WITH q AS (SELECT DISTINCT p_type AS block, p_name AS q FROM part WHERE p_brand = 'Brand#1'), t AS (SELECT DISTINCT p_type AS block, p_name AS t FROM part WHERE p_brand <> 'Brand#1')
    SELECT block, q, arg_min(t, (levenshtein(q, t), t)) AS t, CAST(min(levenshtein(q, t)) AS INTEGER) AS distance FROM q JOIN t USING (block) GROUP BY ALL""",
)
def j10(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_type").alias("block"), "p_name", "p_brand")
    return nearest(part.where("p_brand = 'Brand#1'").withColumnRenamed("p_name", "q"), part.where("p_brand <> 'Brand#1'").withColumnRenamed("p_name", "t"), "block")


def clusters(records: DataFrame, threshold: float) -> DataFrame:
    """(family, taxon, sequence_sha256, cluster): single linkage; a cluster is named by its smallest member."""
    ids = F.concat_ws("|", *BLOCK, "a"), F.concat_ws("|", *BLOCK, "b")
    links = similar_pairs(records, threshold).select(ids[0].alias("src"), ids[1].alias("dst"))
    parts = connected_components(links)
    unique = records.select(*BLOCK, "sequence_sha256").distinct().withColumn("node", F.concat_ws("|", *BLOCK, "sequence_sha256"))
    rows = unique.join(parts, "node", "left")
    return rows.select(*BLOCK, "sequence_sha256", F.coalesce(F.substring_index("component", "|", -1), "sequence_sha256").alias("cluster"))


def _cluster_sql(threshold: float, pairs: str = _PAIRS) -> str:
    return f"""RECURSIVE {pairs}, edge AS (SELECT family, taxon, a, b FROM pair WHERE differences <= floor((1 - {threshold}) * n + 1e-10)),
sym AS (SELECT family, taxon, a, b FROM edge UNION SELECT family, taxon, b, a FROM edge),
reach AS (SELECT family, taxon, sequence_sha256 AS node, sequence_sha256 AS root FROM u UNION SELECT r.family, r.taxon, b.b, r.root FROM reach r JOIN sym b ON r.node = b.a AND r.family = b.family AND r.taxon = b.taxon),
cl AS (SELECT family, taxon, node AS sequence_sha256, min(root) AS cluster FROM reach GROUP BY ALL)"""


_RUN_PAIRS = f"""{fragments_sql(RUN, True)}, u AS (SELECT DISTINCT family, taxon, sequence_sha256, rna, length(rna) AS n FROM frag),
seg AS (SELECT *, substr(rna, CAST(i * n // k AS INTEGER) + 1, CAST((i + 1) * n // k - i * n // k AS INTEGER)) AS piece FROM (SELECT *, unnest(range(k)) AS i FROM (SELECT *, CAST(floor((1 - 0.9) * n + 1e-10) AS INTEGER) + 1 AS k FROM u))),
pair AS (SELECT DISTINCT a.family, a.taxon, a.n, a.sequence_sha256 AS a, b.sequence_sha256 AS b, hamming(a.rna, b.rna) AS differences
  FROM seg a JOIN seg b ON a.family = b.family AND a.taxon = b.taxon AND a.n = b.n AND a.i = b.i AND a.piece = b.piece AND a.sequence_sha256 < b.sequence_sha256 WHERE hamming(a.rna, b.rna) < a.k)"""


def _nodes(pairs: DataFrame) -> DataFrame:
    """Ends of packed pairs as binary nodes src and dst: eight bytes of the block and length, then the string."""
    node = lambda x: F.concat(F.unhex(F.lpad(F.hex("c"), 16, "0")), x)
    return pairs.select(node(F.col("a")).alias("src"), node(F.col("b")).alias("dst"))


def with_clusters(rows: DataFrame) -> DataFrame:
    """Packed strings and their clusters' smallest (q, null for themselves) by digests."""
    return rows.select(*BLOCK, digest(F.col("p"), F.col("n")).alias("sequence_sha256"), F.coalesce(digest(F.col("q"), F.col("n")), digest(F.col("p"), F.col("n"))).alias("cluster"))


@query("G1_components", f"WITH {_cluster_sql(0.9, _RUN_PAIRS)} SELECT family, taxon, sequence_sha256, cluster FROM cl", with_clusters)
def g1(spark: SparkSession, sf: str) -> DataFrame:
    """Every base of every record takes part. Single linkage; a cluster is named by its smallest digest."""
    scratch = Scratch(spark, "runs")
    rows = scratch.write(packed_fragments(spark, sf, RUN, *BLOCK, ends=True).distinct(), "distinct")
    pairs = near_pairs(rows, _bound(0.9), BLOCK, scratch)
    pairs = scratch.write(pairs.select("c", *BLOCK, "n", "a", "b"), "pairs")
    classes = pairs.select("c", *BLOCK, "n").distinct()
    parts = connected_components(_nodes(pairs)).withColumns({"c": F.conv(F.hex(F.expr("substring(node, 1, 8)")), 16, 10).cast("long"), "p": F.expr("substring(node, 9)")})
    parts = scratch.write(parts.join(classes, "c"), "parts")
    least = parts.groupBy("component").agg(F.min_by("p", digest(F.col("p"), F.col("n"))).alias("q"))
    named = parts.join(least, "component").where("p <> q").select(*BLOCK, "n", "p", "q")
    return rows.join(named, [*BLOCK, "n", "p"], "left").select(*BLOCK, "n", "p", "q")


@query(
    "G2_multi_threshold",
    " UNION ALL ".join(
        f"SELECT {t} AS threshold, * FROM (WITH {_cluster_sql(t)} SELECT count(*) AS n, count(DISTINCT (family, taxon, cluster)) AS n_clusters FROM cl)" for t in ("0.99::DOUBLE", "0.95::DOUBLE", "0.9::DOUBLE")
    ),
)
def g2(spark: SparkSession, sf: str) -> DataFrame:
    """One search at the least threshold; a string without a near one is a cluster by itself, so only ends of pairs are linked."""
    scratch = Scratch(spark, "thresholds")
    rows = scratch.write(packed_fragments(spark, sf, FRAGMENT, *BLOCK).distinct(), "distinct")
    pairs = scratch.write(near_pairs(rows, _bound(min(THRESHOLDS)), BLOCK, scratch), "pairs")
    total, out = rows.agg(F.count("*").alias("n")), None
    for t in THRESHOLDS:
        parts = connected_components(_nodes(pairs.where(F.col("differences") <= _bound(t)(F.col("n")))))
        one = total.crossJoin(parts.agg(F.count_if(F.col("node") != F.col("component")).alias("more")))  # one row each
        one = one.select(F.lit(t).alias("threshold"), "n", (F.col("n") - F.col("more")).alias("n_clusters"))
        out = one if out is None else out.unionByName(one)
    return out


def homology_audit(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """One row of each threshold: the graph whose nodes are records (packed: family, taxon, cohort, n, p) and whose edges are pairs
    of records (copies included) with equally long sequences and that identity or more, over all strata.

    Nodes and edges are counted from distinct sequences and their numbers of records; copies are never paired. Only
    sequences that are near to another are joined; of the others their number and copies suffice."""
    scratch = Scratch(rows.sparkSession, "audit")
    n = F.count("*").cast("long")
    strata = scratch.write(rows.groupBy("n", "p", *BLOCK).agg(n.alias("k"), F.count_if(F.col("cohort") == "holdout").alias("ho")), "strata")
    nodes = scratch.write(strata.groupBy("n", "p").agg(F.sum("k").alias("k"), F.sum("ho").alias("ho")), "nodes")
    near = scratch.write(near_pairs(nodes.select("n", "p"), _bound(min(thresholds)), [], scratch).drop("c"), "near")
    ends = near.select("n", F.explode(F.array("a", "b")).alias("p")).distinct()
    strata_met = scratch.write(strata.join(ends, ["n", "p"], "left_semi"), "strata-met")
    met = strata_met.groupBy("n", "p").agg(F.sum("k").alias("k"), F.sum("ho").alias("ho")).withColumn("u", F.monotonically_increasing_id())
    met = scratch.write(met, "met")
    side = lambda x: met.select("n", F.col("p").alias(x), F.col("u").alias(f"u{x}"), F.col("k").alias(f"k{x}"), F.col("ho").alias(f"h{x}"))
    both = near.join(side("a"), ["n", "a"]).join(side("b"), ["n", "b"])
    inside = lambda x: strata_met.select("n", F.col("p").alias(x), *BLOCK, F.col("k").alias(f"x{x}"))
    same = both.select("n", "a", "b", "ua", "ub").join(inside("a"), ["n", "a"]).join(inside("b"), ["n", "b", *BLOCK]).groupBy("ua", "ub").agg(F.sum(F.col("xa") * F.col("xb")).alias("inside"))
    both = both.drop("a", "b").join(same, ["ua", "ub"], "left").fillna(0, ["inside"])
    both = scratch.write(both.withColumn("cross", F.col("ha") * (F.col("kb") - F.col("hb")) + F.col("hb") * (F.col("ka") - F.col("ha"))), "edges")

    none = lambda x: F.coalesce(x, F.lit(0))
    half = lambda x: none(F.sum(x * (x - 1)) / 2)
    k = F.col("k")
    copies = nodes.agg(
        none(F.sum("k")).alias("n_nodes"), half(k).alias("copy_edges"), none(F.sum(F.col("ho") * (k - F.col("ho")))).alias("copy_leaks"),
        n.alias("n_distinct"), none(F.max("k")).alias("most"), F.count_if(k == 1).alias("n_single"),
    )
    alone = scratch.write(copies.crossJoin(strata.agg(half(k).alias("copy_inside"))), "copies")
    out = None
    for t in thresholds:
        e = both.where(F.col("differences") <= _bound(t)(F.col("n")))
        edges = e.agg(
            none(F.sum(F.col("ka") * F.col("kb"))).alias("pairs"),
            none(F.sum("cross")).alias("leaks"),
            none(F.sum("inside")).alias("inside"),
            F.coalesce(F.max(F.when(F.col("cross") > 0, 1 - F.col("differences") / F.col("n"))), F.lit(0.0)).alias("closest"),
        )
        degree = e.select(F.explode(F.array(F.struct(F.col("ua").alias("u"), F.col("ka").alias("k"), F.col("kb").alias("d")), F.struct(F.col("ub").alias("u"), F.col("kb").alias("k"), F.col("ka").alias("d")))).alias("x"))
        degree = degree.groupBy("x.u").agg(F.first("x.k").alias("k"), F.sum("x.d").alias("d"))
        degrees = degree.agg(none(F.max(k - 1 + F.col("d"))).alias("linked_degree"), F.count_if(k == 1).alias("linked_single"))
        parts = met.select(F.col("u").alias("node"), "k").join(connected_components(e, "ua", "ub"), "node")
        sizes = parts.groupBy("component").agg(F.sum("k").alias("size"), n.alias("members"))
        sizes = sizes.agg(none(F.sum(F.col("members") - 1)).alias("merged"), none(F.max("size")).alias("linked_size"))
        row = alone.crossJoin(edges).crossJoin(degrees).crossJoin(sizes).withColumn("n_components", F.col("n_distinct") - F.col("merged"))  # one row each
        all_edges = F.col("pairs") + F.col("copy_edges")
        row = row.select(
            F.lit(t).alias("threshold"),
            "n_nodes",
            all_edges.cast("long").alias("n_edges"),
            "n_components",
            (F.col("leaks") + F.col("copy_leaks")).cast("long").alias("n_leaking"),
            (all_edges - F.col("inside") - F.col("copy_inside")).cast("long").alias("n_cross_stratum"),
            F.greatest("most", "linked_size").alias("max_component"),
            r6(F.when(F.col("n_components") > 0, F.col("n_nodes") / F.col("n_components")).otherwise(0.0)).alias("mean_component"),
            F.greatest(F.greatest(F.col("most") - 1, F.lit(0)), "linked_degree").alias("max_degree"),
            (F.col("n_single") - F.col("linked_single")).alias("n_isolated"),
            r6(F.when(F.col("copy_leaks") > 0, 1.0).otherwise(F.col("closest"))).alias("closest_leak"),
            ((F.col("leaks") + F.col("copy_leaks")) > 0).alias("warns"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def cohort_counts(rows: DataFrame, *block: str) -> DataFrame:
    """(block, n, p, h, t): each distinct packed string with its numbers of records in holdout and elsewhere."""
    return rows.groupBy(*block, "n", "p").agg(F.count_if(F.col("cohort") == "holdout").alias("h"), F.count_if(F.col("cohort") != "holdout").alias("t"))


def leakage_warnings(rows: DataFrame, least: float = REPORT) -> DataFrame:
    """(n, a, b, differences, n_holdout, n_training): each pair of packed sequences of identity `least` or more with a in holdout and b in
    training, with the records that have them. A sequence in both cohorts is such a pair with itself; copies are
    counted, not listed. rows: cohort, n, p."""
    scratch = Scratch(rows.sparkSession, "warnings")
    nodes = scratch.write(cohort_counts(rows), "nodes")
    near = near_pairs(nodes, _bound(least), [], scratch, cross=True)
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"h{a}").alias("n_holdout"), F.col(f"t{b}").alias("n_training"))
    ways = F.filter(F.array(way("a", "b"), way("b", "a")), lambda w: (w["n_holdout"] > 0) & (w["n_training"] > 0))
    found = near.select("n", "differences", F.explode(ways).alias("w")).select("n", "w.a", "w.b", "differences", F.col("w.n_holdout").cast("long").alias("n_holdout"), F.col("w.n_training").cast("long").alias("n_training"))
    many = scratch.write(nodes.where((F.col("h") >= MANY) | (F.col("t") >= MANY)), "many")
    if many.limit(1).count():
        found = found.join(many.select("n", F.col("p").alias("a"), "h"), ["n", "a"], "left").join(many.select("n", F.col("p").alias("b"), "t"), ["n", "b"], "left")
        found = found.select("n", "a", "b", "differences", F.coalesce("h", "n_holdout").alias("n_holdout"), F.coalesce("t", "n_training").alias("n_training"))
    own = nodes.where("h > 0 AND t > 0").select("n", F.col("p").alias("a"), F.col("p").alias("b"), F.lit(0).alias("differences"), F.col("h").alias("n_holdout"), F.col("t").alias("n_training"))
    return found.unionByName(own)


def with_thresholds(rows: DataFrame) -> DataFrame:
    """Warnings by digests, a row for each threshold that makes an edge of them."""
    identity = 1 - F.col("differences") / F.col("n")
    levels = F.filter(F.array(*map(F.lit, sorted({*THRESHOLDS, REPORT}))), lambda t: identity >= t - 1e-10)
    named = rows.select(levels.alias("levels"), digest(F.col("a"), F.col("n")).alias("holdout_sha256"), digest(F.col("b"), F.col("n")).alias("training_sha256"), r6(identity).alias("identity"), "n_holdout", "n_training")
    return named.select(F.explode("levels").alias("threshold"), "holdout_sha256", "training_sha256", "identity", "n_holdout", "n_training")


@query(
    "G3_leakage_warnings",
    f"""WITH {_pairs_sql(REPORT, FRAGMENT, False)}, nd AS (SELECT sequence_sha256 AS s, count(*) FILTER (cohort = 'holdout') AS h, count(*) FILTER (cohort <> 'holdout') AS t FROM frag GROUP BY 1),
    e AS (SELECT a, b, 1 - differences / n AS i FROM pair UNION ALL SELECT b, a, 1 - differences / n FROM pair UNION ALL SELECT s, s, 1.0 FROM nd)
    SELECT threshold, a AS holdout_sha256, b AS training_sha256, round(i, 6) + 0.0 AS identity, x.h AS n_holdout, y.t AS n_training
    FROM (SELECT *, unnest([{", ".join(f"{t}::DOUBLE" for t in (*THRESHOLDS, REPORT))}]) AS threshold FROM e) JOIN nd x ON x.s = a AND x.h > 0 JOIN nd y ON y.s = b AND y.t > 0 WHERE i >= threshold - 1e-10""",
    with_thresholds,
)
def g3_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return leakage_warnings(packed_fragments(spark, sf, FRAGMENT, "cohort"))


def _audit_sql(t: float) -> str:
    return f"""SELECT * FROM (WITH RECURSIVE {fragments_sql(FRAGMENT)}, u AS (SELECT sequence_sha256 AS s, any_value(rna) AS rna, length(any_value(rna)) AS n, count(*) AS k, count(*) FILTER (cohort = 'holdout') AS ho FROM frag GROUP BY 1),
seg AS (SELECT s, i, substr(rna, CAST(i * n // 5 AS INTEGER) + 1, CAST((i + 1) * n // 5 - i * n // 5 AS INTEGER)) AS piece FROM (SELECT *, unnest(range(5)) AS i FROM u)),
st AS (SELECT sequence_sha256 AS s, family, taxon, count(*) AS k FROM frag GROUP BY ALL),
pair AS (SELECT a.s AS a, b.s AS b, a.n, hamming(a.rna, b.rna) AS d, a.k AS ka, b.k AS kb, a.ho * (b.k - b.ho) + b.ho * (a.k - a.ho) AS x FROM (SELECT DISTINCT p.s AS ps, q.s AS qs FROM seg p JOIN seg q ON p.i = q.i AND p.piece = q.piece AND p.s < q.s) m JOIN u a ON a.s = ps JOIN u b ON b.s = qs AND hamming(a.rna, b.rna) <= floor((1 - {t}) * a.n + 1e-10)),
ends AS (SELECT a AS s, b AS o, kb AS d FROM pair UNION ALL SELECT b, a, ka FROM pair),
reach AS (SELECT DISTINCT s AS node, s AS root FROM ends UNION SELECT e.o, r.root FROM reach r JOIN ends e ON r.node = e.s),
part AS (SELECT u.k, coalesce(m.root, u.s) AS c FROM u LEFT JOIN (SELECT node, min(root) AS root FROM reach GROUP BY 1) m ON m.node = u.s),
size AS (SELECT c, sum(k) AS size FROM part GROUP BY c),
deg AS (SELECT u.k - 1 + coalesce(sum(d), 0) AS degree FROM u LEFT JOIN ends USING (s) GROUP BY u.s, u.k),
same AS (SELECT coalesce(sum(x.k * y.k), 0) AS inside FROM pair p JOIN st x ON x.s = p.a JOIN st y ON y.s = p.b AND y.family = x.family AND y.taxon = x.taxon),
v AS (SELECT (SELECT coalesce(sum(k), 0) FROM u) AS n_nodes, (SELECT coalesce(sum(ka * kb), 0) FROM pair) + (SELECT coalesce(sum(k * (k - 1) // 2), 0) FROM u) AS n_edges,
  (SELECT coalesce(sum(x), 0) FROM pair) AS leaks, (SELECT coalesce(sum(ho * (k - ho)), 0) FROM u) AS copy_leaks, (SELECT count(*) FROM size) AS n_components)
SELECT CAST({t} AS DOUBLE) AS threshold, CAST(n_nodes AS BIGINT) AS n_nodes, CAST(n_edges AS BIGINT) AS n_edges, n_components, CAST(leaks + copy_leaks AS BIGINT) AS n_leaking,
  CAST(n_edges - (SELECT inside FROM same) - (SELECT coalesce(sum(k * (k - 1) // 2), 0) FROM st) AS BIGINT) AS n_cross_stratum, CAST((SELECT coalesce(max(size), 0) FROM size) AS BIGINT) AS max_component,
  round(n_nodes / n_components, 6) + 0.0 AS mean_component, CAST((SELECT coalesce(max(degree), 0) FROM deg) AS BIGINT) AS max_degree, (SELECT count(*) FROM deg WHERE degree = 0) AS n_isolated,
  round(CASE WHEN copy_leaks > 0 THEN 1.0 ELSE coalesce((SELECT max(1 - d / n) FROM pair WHERE x > 0), 0) END, 6) + 0.0 AS closest_leak, leaks + copy_leaks > 0 AS warns FROM v)"""


@query("G3_homology_audit", " UNION ALL ".join(map(_audit_sql, THRESHOLDS)))
def g3(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between cohorts are the leakage that exact keys do not show."""
    return homology_audit(packed_fragments(spark, sf, FRAGMENT, *BLOCK, "cohort"))


@query(
    "G6_leakage_profile",
    f"""WITH {_PAIRS}, tr AS (SELECT DISTINCT family, taxon, sequence_sha256 FROM frag WHERE cohort = 'training'), near AS (SELECT * FROM pair WHERE differences <= floor((1 - 0.9) * n + 1e-10)),
    e AS (SELECT family, taxon, a AS s, b AS t, 1 - differences / n AS i FROM near UNION ALL SELECT family, taxon, b, a, 1 - differences / n FROM near),
    best AS (SELECT e.family, e.taxon, s, max(i) AS i FROM e JOIN tr ON tr.family = e.family AND tr.taxon = e.taxon AND tr.sequence_sha256 = t GROUP BY ALL)
    SELECT c.doc_id, count(*) AS n, count(x.sequence_sha256) AS n_exact, count(CASE WHEN x.sequence_sha256 IS NULL THEN i END) AS n_near, round(max(CASE WHEN x.sequence_sha256 IS NOT NULL THEN 1 ELSE i END), 6) + 0.0 AS identity
    FROM frag c LEFT JOIN tr x ON x.family = c.family AND x.taxon = c.taxon AND x.sequence_sha256 = c.sequence_sha256
    LEFT JOIN best b ON b.family = c.family AND b.taxon = c.taxon AND b.s = c.sequence_sha256 WHERE c.cohort = 'holdout' GROUP BY c.doc_id""",
)
def g6(spark: SparkSession, sf: str) -> DataFrame:
    """Of each holdout record: fragments, those that training of its stratum has exactly, or else at 0.9 or more, and the
    highest identity; null if none is near."""
    scratch, at = Scratch(spark, "profile"), [*BLOCK, "n", "p"]
    nodes = scratch.write(cohort_counts(packed_fragments(spark, sf, FRAGMENT, *BLOCK, "cohort"), *BLOCK), "nodes")
    near = near_pairs(nodes, _bound(0.9), BLOCK, scratch, cross=True)
    way = lambda a, b: F.when((F.col(f"h{a}") > 0) & (F.col(f"t{a}") == 0) & (F.col(f"t{b}") > 0), F.col(a))
    best = near.select(*BLOCK, "n", "differences", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).where("p IS NOT NULL").groupBy(*at).agg(F.min("differences").alias("d"))
    marks = best.unionByName(nodes.dropna(subset=BLOCK).where("h > 0 AND t > 0").select(*at, F.lit(0).alias("d")))
    asked = packed_fragments(spark, sf, FRAGMENT, "doc_id", *BLOCK, "cohort").where("cohort = 'holdout'").groupBy("doc_id", *at).agg(F.count("*").alias("k"))
    rows = asked.join(marks, at, "left")
    exact = F.col("d") == 0  # distinct strings have a difference
    return rows.groupBy("doc_id").agg(
        F.sum("k").alias("n"),
        F.sum(F.when(exact, F.col("k")).otherwise(0)).alias("n_exact"),
        F.sum(F.when(F.col("d") > 0, F.col("k")).otherwise(0)).alias("n_near"),
        r6(F.max(1 - F.col("d") / F.col("n"))).alias("identity"),
    )


#: Chances of a Poisson count of mean one: below the k-th bound a unit is drawn k times.
POISSON = (0.367879441171442, 0.735758882342885, 0.919698602928606, 0.981011843123846, 0.996340153172656, 0.999405815182418)


def bootstrap(units: DataFrame, stratum: str, value: str, key: str, draws: int, seed: int = 17) -> DataFrame:
    """(stratum, n_units, mean, sd, lower, upper) of the mean over resampled units.

    A unit's number of copies in a draw is a Poisson count from the hash of (seed, draw, unit), so a
    draw needs no places, no order and no row but its own: sums combine before the shuffle."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    copies = sum(((F.col("u") >= b).cast("int") for b in POISSON), F.lit(0))
    drawn = units.select(stratum, key, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("u", u).withColumn("c", copies)
    sums = drawn.groupBy(stratum, "draw").agg(F.sum("c").alias("w"), F.sum(F.col("c") * F.col(value)).alias("s"), F.count("*").alias("k")).where("w > 0")
    means = sums.select(stratum, "draw", "k", (F.col("s") / F.col("w")).alias("m"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("m", "draw")) - 1
    n = F.count("*").over(Window.partitionBy(stratum))
    ranked = means.withColumns({"place": place, "n": n})
    at = lambda q: F.max(F.when(F.col("place") == F.floor(q * F.col("n")), F.col("m")))
    return ranked.groupBy(stratum).agg(F.max("k").alias("n_units"), r6(F.avg("m")).alias("mean"), r6(F.stddev_samp("m")).alias("sd"), r6(at(0.025)).alias("lower"), r6(at(0.975)).alias("upper"))


@query(
    "G4_cluster_bootstrap",
    f"""WITH v AS (SELECT c_mktsegment AS stratum, c_custkey AS unit, c_acctbal AS x FROM customer), d AS (SELECT *, unnest(range(100)) AS draw FROM v),
    u AS (SELECT *, CAST(('0x' || substr(md5('17:' || draw || ':' || unit), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u FROM d),
    c AS (SELECT *, {' + '.join(f'CAST(u >= CAST({b!r} AS DOUBLE) AS INTEGER)' for b in POISSON)} AS c FROM u), s AS (SELECT stratum, draw, sum(c) AS w, sum(c * x) AS s, count(*) AS k FROM c GROUP BY ALL HAVING sum(c) > 0),
    m AS (SELECT stratum, draw, k, s / w AS m, row_number() OVER (PARTITION BY stratum ORDER BY s / w, draw) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS n FROM s)
    SELECT stratum, max(k) AS n_units, round(avg(m), 6) + 0.0 AS mean, round(stddev_samp(m), 6) + 0.0 AS sd, round(max(CASE WHEN place = floor(0.025 * n) THEN m END), 6) + 0.0 AS lower, round(max(CASE WHEN place = floor(0.975 * n) THEN m END), 6) + 0.0 AS upper FROM m GROUP BY stratum""",
)
def g4(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("x"))
    return bootstrap(units, "stratum", "x", "unit", 100)


@query(
    "G5_paired_contrast",
    """WITH v AS (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY ALL), d AS (SELECT a.s - b.s AS delta FROM v a JOIN v b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view')
    SELECT count(*) AS n, round(avg(delta), 6) + 0.0 AS mean, round(stddev_samp(delta), 6) + 0.0 AS sd, CASE WHEN count(*) < 2 THEN 'Provisional' WHEN min(delta) > 0 THEN 'Met' WHEN max(delta) < 0 THEN 'Reversed' ELSE 'Unchanged' END AS verdict FROM d""",
)
def g5(spark: SparkSession, sf: str) -> DataFrame:
    from .joins import j12

    verdict = F.when(F.count("*") < 2, "Provisional").when(F.min("delta") > 0, "Met").when(F.max("delta") < 0, "Reversed").otherwise("Unchanged")
    return j12(spark, sf).agg(F.count("*").alias("n"), r6(F.avg("delta")).alias("mean"), r6(F.stddev_samp("delta")).alias("sd"), verdict.alias("verdict"))
