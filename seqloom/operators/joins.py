"""Joins and set operations over records: lookups, holdout splits, leakage checks, overlaps.

Keys are content hashes and accessions, so sides are reduced to their distinct keys before a
shuffle; texts never move with them unless a result holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import stable_accession
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import CDS_SQL, cds, table


@query(
    "J1_dimension_lookup",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def j1(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query(
    "J2_alias_join",
    """WITH alias(a, candidate) AS (VALUES ('ring', 'C1'), ('small', 'C1'), ('bolt', 'C2'), ('large', 'C3'), ('nut', 'C2'), ('gear', 'C3')),
    w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS a FROM part)
    SELECT p_partkey, candidate, max(a) AS matched FROM w JOIN alias USING (a) GROUP BY ALL""",
)
def j2(spark: SparkSession, sf: str) -> DataFrame:
    """A row may match several candidates; of its matches with one, the last alias counts."""
    alias = spark.createDataFrame([("ring", "C1"), ("small", "C1"), ("bolt", "C2"), ("large", "C3"), ("nut", "C2"), ("gear", "C3")], "a string, candidate string")
    words = table(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("a"))
    return words.join(F.broadcast(alias), "a").groupBy("p_partkey", "candidate").agg(F.max("a").alias("matched"))


@query(
    "J3_ambiguous_match",
    """WITH dim(candidate, names, brand) AS (VALUES ('C1', ['ring', 'bolt'], 'Brand#1'), ('C2', ['nut'], 'Brand#2'), ('C3', ['gear', 'large'], 'Brand#3'))
    SELECT p_partkey, count(*) AS n, min(candidate) AS candidate, count(*) > 1 AS ambiguous FROM part JOIN dim ON list_has_any(string_split(p_name, ' '), names) OR p_brand = brand GROUP BY p_partkey""",
)
def j3(spark: SparkSession, sf: str) -> DataFrame:
    """A disjunction as an equi join: every key of either kind is one row, counted once a candidate."""
    rows = [("C1", ["ring", "bolt"], "Brand#1"), ("C2", ["nut"], "Brand#2"), ("C3", ["gear", "large"], "Brand#3")]
    keys = [(c, "name", n) for c, names, _ in rows for n in names] + [(c, "brand", b) for c, _, b in rows]
    dim = spark.createDataFrame(keys, "candidate string, kind string, value string")
    mine = F.transform(F.split("p_name", " "), lambda n: F.struct(F.lit("name").alias("kind"), n.alias("value")))
    brand = F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")))
    found = table(spark, sf, "part").select("p_partkey", F.inline(F.array_distinct(F.concat(mine, brand)))).join(F.broadcast(dim), ["kind", "value"])
    found = found.groupBy("p_partkey").agg(F.count_distinct("candidate").alias("n"), F.min("candidate").alias("candidate"))
    return found.withColumn("ambiguous", F.col("n") > 1)


@query(
    "J4_reference_lookup",
    f"""WITH {CDS_SQL}, ref AS (SELECT family, taxon, min(doc_id) AS reference FROM cds JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL)
    SELECT doc_id, reference, CASE WHEN reference IS NULL THEN 'no_reviewed_reference' END AS reason FROM cds LEFT JOIN ref USING (family, taxon)""",
)
def j4(spark: SparkSession, sf: str) -> DataFrame:
    records = cds(spark, sf).select("doc_id", "family", "taxon")
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    reference = records.join(good, "doc_id").groupBy("family", "taxon").agg(F.min("doc_id").alias("reference"))
    rows = records.join(reference, ["family", "taxon"], "left")
    return rows.select("doc_id", "reference", F.when(F.col("reference").isNull(), "no_reviewed_reference").alias("reason"))


@query(
    "J5_reference_fan_out",
    "SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)
def j5(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return table(spark, sf, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


def holdout_split(holdout: DataFrame, training: DataFrame) -> DataFrame:
    """holdout's id and keys with the reason why a row leaks, null for what may be kept.

    A row leaks by its sequence, else by an accession (own or parent's, without version) that
    training has. Both sides are reduced to distinct keys first."""
    known = training.select("sequence_sha256").distinct().withColumn("same_rna", F.lit(True))
    names = F.explode(F.array(stable_accession(F.col("accession")), stable_accession(F.col("parent_accession")))).alias("name")
    taken = training.select(names).distinct()
    shared = holdout.select("doc_id", names).join(taken, "name", "left_semi").select("doc_id").distinct().withColumn("same_name", F.lit(True))
    rows = holdout.join(known, "sequence_sha256", "left").join(shared, "doc_id", "left")
    reason = F.when(F.col("same_rna"), "training_rna_duplicate").when(F.col("same_name"), "training_source_accession_overlap")
    return rows.select("doc_id", "sequence_sha256", "family", "taxon", reason.alias("reason"))


_SPLIT = f"""{CDS_SQL}, names AS (SELECT doc_id, cohort, regexp_replace(unnest([accession, parent_accession]), '\\.\\d+$', '') AS name FROM cds), split AS (
  SELECT doc_id, sequence_sha256, family, taxon, CASE WHEN sequence_sha256 IN (SELECT sequence_sha256 FROM cds WHERE cohort = 'training') THEN 'training_rna_duplicate'
    WHEN doc_id IN (SELECT doc_id FROM names WHERE cohort = 'holdout' AND name IN (SELECT name FROM names WHERE cohort = 'training')) THEN 'training_source_accession_overlap' END AS reason
  FROM cds WHERE cohort = 'holdout'
)"""


@query("J6_holdout_split", f"WITH {_SPLIT} SELECT * FROM split")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    # whole texts are read and hashed once; the branches read the keys
    records = Scratch(spark, "keys").write(cds(spark, sf).drop("rna"), "records")
    return holdout_split(records.where("cohort = 'holdout'"), records.where("cohort = 'training'"))


@query(
    "J7_leakage_verify",
    f"""WITH {_SPLIT}, kept AS (SELECT * FROM split WHERE reason IS NULL) SELECT (SELECT count(*) FROM kept) AS n_kept,
      (SELECT count(*) FROM (SELECT doc_id FROM kept GROUP BY doc_id HAVING count(*) > 1)) AS n_duplicate_ids,
      (SELECT count(*) FROM kept WHERE sequence_sha256 IN (SELECT sequence_sha256 FROM cds WHERE cohort = 'training')) AS n_rna_overlap""",
)
def j7(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of what must not be there; all but n_kept should be zero."""
    records = Scratch(spark, "keys").write(cds(spark, sf).drop("rna"), "records")
    training = records.where("cohort = 'training'")
    kept = holdout_split(records.where("cohort = 'holdout'"), training).where("reason IS NULL").select("doc_id", "sequence_sha256")
    twice = kept.groupBy("doc_id").agg(F.count("*").alias("n"))
    counts = twice.agg(F.sum("n").alias("n_kept"), F.count_if(F.col("n") > 1).alias("n_duplicate_ids"))
    overlap = kept.join(training.select("sequence_sha256").distinct(), "sequence_sha256", "left_semi").agg(F.count("*").alias("n_rna_overlap"))
    return counts.join(overlap)  # one row each


@query(
    "J11_record_lookup",
    "SELECT l_returnflag, o_orderpriority, count(*) AS n, round(sum(l_quantity), 6) + 0.0 AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
)
def j11(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag", "o_orderpriority")
    return joined.agg(F.count("*").alias("n"), (F.round(F.sum("l_quantity"), 6) + F.lit(0.0)).alias("quantity"))


@query(
    "J12_paired_arms",
    """WITH v AS (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY ALL), a AS (SELECT user_id, s FROM v WHERE event_type = 'click'), b AS (SELECT user_id, s FROM v WHERE event_type = 'view')
    SELECT user_id, round(a.s - b.s, 6) + 0.0 AS delta FROM a JOIN b USING (user_id)""",
)
def j12(spark: SparkSession, sf: str) -> DataFrame:
    """Arms side by side for seeds that have both: one conditional aggregate instead of a self join."""
    of = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value")))
    has = lambda t: F.count_if(F.col("event_type") == t) > 0
    rows = table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id")
    both = rows.agg(of("click").alias("a"), of("view").alias("b"), (has("click") & has("view")).alias("both")).where("both")
    return both.select("user_id", (F.round(F.col("a") - F.col("b"), 6) + F.lit(0.0)).alias("delta"))


@query(
    "J13_overlap_matrix",
    f"""WITH {CDS_SQL}, v AS (SELECT DISTINCT family AS view_name, sequence_sha256 FROM cds) SELECT a.view_name AS a, b.view_name AS b, count(*) AS n
    FROM v a JOIN v b USING (sequence_sha256) WHERE a.view_name <= b.view_name GROUP BY ALL""",
)
def j13(spark: SparkSession, sf: str) -> DataFrame:
    """|A and B| of all pairs of views: each sequence names the views it is in, a handful at most."""
    views = cds(spark, sf).groupBy("sequence_sha256").agg(F.sort_array(F.collect_set("family")).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return views.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    "J14_reconciliation",
    """WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS planned FROM orders), r AS (SELECT l_orderkey AS k, count(*) AS n, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1)
    SELECT coalesce(p.k, r.k) AS k, p.k IS NOT NULL AS is_planned, r.k IS NOT NULL AS has_run, coalesce(n, 0) AS n_runs, (planned = 'F') = coalesce(done, false) AS status_agrees FROM p FULL JOIN r ON p.k = r.k""",
)
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """Plan against runs: a full outer join with one column for each rule."""
    plan = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("planned"))
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("r")).agg(F.count("*").alias("n"), F.bool_and(F.col("l_linestatus") == "F").alias("done"))
    both = plan.join(runs, F.col("k") == F.col("r"), "full")
    return both.select(
        F.coalesce("k", "r").alias("k"),
        F.col("k").isNotNull().alias("is_planned"),
        F.col("r").isNotNull().alias("has_run"),
        F.coalesce("n", F.lit(0)).alias("n_runs"),
        ((F.col("planned") == "F") == F.coalesce("done", F.lit(False))).alias("status_agrees"),
    )


@query(
    "J15_jobs_in_order",
    "WITH j(place, job) AS (VALUES (0, '5-LOW'), (1, '1-URGENT'), (2, 'X-MISSING'), (3, '2-HIGH')) SELECT place, job, count(o_orderkey) AS n, count(o_orderkey) = 0 AS missing FROM j LEFT JOIN orders ON job = o_orderpriority GROUP BY ALL",
)
def j15(spark: SparkSession, sf: str) -> DataFrame:
    jobs = spark.createDataFrame([(0, "5-LOW"), (1, "1-URGENT"), (2, "X-MISSING"), (3, "2-HIGH")], "place int, job string")
    runs = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("job")).agg(F.count("*").alias("n"))
    rows = jobs.join(runs, "job", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("place", "job", "n", (F.col("n") == 0).alias("missing"))


@query(
    "J16_conservation_overlay",
    f"""WITH {CDS_SQL}, own AS (SELECT DISTINCT sequence_sha256 FROM cds WHERE cohort = 'training'), u AS (SELECT sequence_sha256, count(*) AS n FROM cds GROUP BY 1)
    SELECT doc_id, n AS n_union, o.sequence_sha256 IS NOT NULL AS visible FROM cds JOIN u USING (sequence_sha256) LEFT JOIN own o USING (sequence_sha256)""",
)
def j16(spark: SparkSession, sf: str) -> DataFrame:
    """Counts from the union, visibility from the own cohort: one aggregate gives both."""
    records = cds(spark, sf).select("doc_id", "sequence_sha256", "cohort")
    both = records.groupBy("sequence_sha256").agg(F.count("*").alias("n_union"), F.bool_or(F.col("cohort") == "training").alias("visible"))
    return records.join(both, "sequence_sha256").select("doc_id", "n_union", "visible")


@query("O1_ranked_sort", "SELECT source, lang, n, CAST(row_number() OVER (ORDER BY n DESC, source, lang) AS INTEGER) AS place FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)")
def o1(spark: SparkSession, sf: str) -> DataFrame:
    """Descending counts, ties by name; places are those of groups, of which there are few."""
    from pyspark.sql import Window

    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source", "lang")))


@query("O2_canonical_order", f"WITH {CDS_SQL} SELECT sequence_sha256, count(*) AS n, min(doc_id) AS doc_id FROM cds GROUP BY 1 ORDER BY 1")
def o2(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).groupBy("sequence_sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).orderBy("sequence_sha256")


@query("O3_winner", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 1")
def o3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1)


@query(
    "O4_union_routes",
    "SELECT 'doc' AS route, doc_id AS id, length(text) AS n, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'page', page_id, length(html), url FROM pages",
)
def o4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("route"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    pages = table(spark, sf, "pages").select(F.lit("page").alias("route"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("n"), "url")
    return docs.unionByName(pages, allowMissingColumns=True)


@query("O5_set_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def o5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("O6_intersect", f"WITH {CDS_SQL} SELECT sequence_sha256 FROM cds WHERE cohort = 'training' INTERSECT SELECT sequence_sha256 FROM cds WHERE cohort = 'holdout'")
def o6(spark: SparkSession, sf: str) -> DataFrame:
    keys = cds(spark, sf).select("sequence_sha256", "cohort")
    return keys.where("cohort = 'training'").select("sequence_sha256").intersect(keys.where("cohort = 'holdout'").select("sequence_sha256"))


@query("O7_subset_check", "SELECT count(*) AS n_missing FROM (SELECT DISTINCT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def o7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id").distinct().join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_missing"))


@query(
    "O8_panel_equality",
    """SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS only_a, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS only_b""",
)
def o8(spark: SparkSession, sf: str) -> DataFrame:
    """Both differences from one pass: which sides have a key."""
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    sides = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sides.agg(F.count_if(F.col("a") > F.col("b")).alias("only_a"), F.count_if(F.col("b") > F.col("a")).alias("only_b"))


@query("O9_duplicates", f"WITH {CDS_SQL} SELECT sequence_sha256, count(*) AS n FROM cds GROUP BY 1 HAVING count(*) > 1")
def o9(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).groupBy("sequence_sha256").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "O10_experiment_grid",
    f"""WITH {CDS_SQL}, f AS (SELECT family, count(*) AS n, min(length(rna) // 3) AS shortest FROM cds GROUP BY family)
    SELECT family, CAST(g AS INTEGER) AS gap, CAST(l AS INTEGER) AS left_codons, CAST(s AS INTEGER) AS seed, arm, n, shortest >= g + l AS all_fit
    FROM f, unnest([1, 2, 4, 8, 16]) a(g), unnest([4, 8, 16, 32]) b(l), unnest([17, 29, 43]) c(s), unnest(['base', 'codon']) d(arm)""",
)
def o10(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of each family of the records, and whether a case fits all of them."""
    families = cds(spark, sf).groupBy("family").agg(F.count("*").alias("n"), F.min(F.floor(F.length("rna") / 3)).alias("shortest"))
    grid = experiment_grid(families, {"gap": [1, 2, 4, 8, 16], "left_codons": [4, 8, 16, 32], "seed": [17, 29, 43], "arm": ["base", "codon"]})
    return grid.withColumn("all_fit", F.col("shortest") >= F.col("gap") + F.col("left_codons")).drop("shortest")


def experiment_grid(rows: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Every row with every combination of a few parameters."""
    for name, values in axes.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows
