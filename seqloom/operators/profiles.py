"""Positional profiles, codon usage indices, coverage scores and report aggregates.

Everything is counts first (partial aggregation before each shuffle), then small expressions over
the counts; ratios are rounded once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.codes import GC_SQL, USAGE_SQL, VOCABULARY_SQL
from ..functions.sequence import entropy_bits, r6
from ..registry import query
from ..sources.views import CDS_SQL, CODONS_SQL, COVERAGE_SQL, cds, codon_rows, coverage, table
from .sampling import variable_positions


def allele_counts(records: DataFrame, *by: str) -> DataFrame:
    """(by, pos, codon, n)."""
    return codon_rows(records, *by).groupBy(*by, "pos", "codon").agg(F.count("*").alias("n"))


def positional_entropy(counts: DataFrame, *by: str, classes: int = 64) -> DataFrame:
    """(by, pos, n, alleles, entropy, conservation) of allele counts.

    H = log2 N - sum(n log2 n) / N needs no second look at the total."""
    nlog = F.sum(F.col("n") * F.log2("n"))
    rows = counts.groupBy(*by, "pos").agg(F.sum("n").alias("total"), F.count("*").alias("alleles"), nlog.alias("nlog"))
    h = F.greatest(F.lit(0.0), F.log2("total") - F.col("nlog") / F.col("total"))
    score = F.when(F.col("total") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / F.log2(F.lit(float(classes))))))
    return rows.select(*by, "pos", F.col("total").alias("n"), "alleles", r6(h).alias("entropy"), r6(score).alias("conservation"))


@query(
    "A8_category_counts",
    f"WITH {CODONS_SQL} SELECT family, codon, count(*) AS n, min(pos) AS first_pos FROM codon WHERE pos > 0 GROUP BY ALL",
)
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return codon_rows(cds(spark, sf), "family").where("pos > 0").groupBy("family", "codon").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query(
    "A9_A10_positional_entropy",
    f"""WITH {CODONS_SQL}, c AS (SELECT family, pos, codon, count(*) AS k FROM codon GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY family, pos) AS p, sum(k) OVER (PARTITION BY family, pos) AS t FROM c),
    h AS (SELECT family, pos, CAST(max(t) AS BIGINT) AS n, count(*) AS alleles, greatest(0, -sum(p * log2(p))) AS h FROM p GROUP BY ALL)
    SELECT family, pos, n, alleles, round(h, 6) + 0.0 AS entropy, round(CASE WHEN n <= 1 THEN 1 ELSE greatest(0, least(1, 1 - h / 6)) END, 6) + 0.0 AS conservation FROM h""",
)
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return positional_entropy(allele_counts(cds(spark, sf), "family"), "family")


@query(
    "A11_positional_profile",
    f"WITH {CODONS_SQL} SELECT family, taxon, pos, codon, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY family, taxon, pos), 6) + 0.0 AS share FROM codon GROUP BY family, taxon, pos, codon",
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    n = allele_counts(cds(spark, sf), "family", "taxon")
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("family", "taxon", "pos"))))


def consensus(counts: DataFrame, *by: str) -> DataFrame:
    """(by, pos, codon, n): the most frequent codon, ties to the first in vocabulary order."""
    from ..functions.sequence import codon_index

    best = F.max(F.struct("n", (-codon_index(F.col("codon"))).alias("order"), "codon"))
    return counts.groupBy(*by, "pos").agg(best.alias("b")).select(*by, "pos", "b.codon", "b.n")


@query(
    "A12_consensus_profile",
    f"""WITH {CODONS_SQL}, {VOCABULARY_SQL}, c AS (SELECT family, pos, codon, count(*) AS n FROM codon GROUP BY ALL)
    SELECT family, pos, codon, n FROM c JOIN vocab USING (codon) QUALIFY row_number() OVER (PARTITION BY family, pos ORDER BY n DESC, id) = 1""",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return consensus(allele_counts(cds(spark, sf), "family"), "family")


@query(
    "A13_diversity",
    f"""WITH {CODONS_SQL}, l AS (SELECT family, taxon, len(cs) AS len, doc_id, cs FROM (SELECT * FROM split)), g AS (SELECT family, taxon, len, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 1),
    e AS (SELECT family, taxon, len, unnest(cs) AS codon, unnest(range(len)) AS pos FROM l), c AS (SELECT family, taxon, len, pos, codon, count(*) AS k FROM e GROUP BY ALL),
    s AS (SELECT family, taxon, len, sum(k * (k - 1) / 2) AS same FROM c GROUP BY ALL)
    SELECT family, taxon, len AS n_codons, n, round(same / (len * n * (n - 1) / 2), 6) + 0.0 AS mean_identity FROM g JOIN s USING (family, taxon, len)""",
)
def a13(spark: SparkSession, sf: str) -> DataFrame:
    """Mean pairwise identity in closed form: equal pairs are counted by place, never listed."""
    n_codons = (F.length("rna") / 3).cast("long")
    records = cds(spark, sf).withColumn("n_codons", n_codons)
    sizes = records.groupBy("family", "taxon", "n_codons").agg(F.count("*").alias("n")).where("n > 1")
    counts = allele_counts(records, "family", "taxon", "n_codons")
    same = counts.groupBy("family", "taxon", "n_codons").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    pairs = F.col("n_codons") * F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(same, ["family", "taxon", "n_codons"]).select("family", "taxon", "n_codons", "n", r6(F.col("same") / pairs).alias("mean_identity"))


@query(
    "A14_linear_diversity",
    f"""WITH {CODONS_SQL}, v AS (SELECT family, taxon, pos, count(DISTINCT codon) AS k, count(*) AS n FROM codon WHERE pos > 0 GROUP BY ALL)
    SELECT family, count(*) FILTER (k > 1) AS variable_sites, CAST(sum(n) FILTER (k > 1) AS BIGINT) AS occurrences FROM v GROUP BY family""",
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    rows = codon_rows(cds(spark, sf), "family", "taxon").where("pos > 0").groupBy("family", "taxon", "pos")
    v = rows.agg((F.min("codon") != F.max("codon")).alias("variable"), F.count("*").alias("n"))
    return v.groupBy("family").agg(F.count_if("variable").alias("variable_sites"), F.sum(F.when(F.col("variable"), F.col("n"))).alias("occurrences"))


@query(
    "A15_codon_coverage",
    f"WITH {CODONS_SQL}, {VOCABULARY_SQL}, c AS (SELECT codon, count(*) AS n FROM codon GROUP BY 1) SELECT codon, coalesce(n, 0) AS n FROM vocab LEFT JOIN c USING (codon)",
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    n = codon_rows(cds(spark, sf)).groupBy("codon").agg(F.count("*").alias("n"))
    return codes.vocabulary(spark).join(n, "codon", "left").select("codon", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "A16_rscu",
    f"""WITH {CODONS_SQL}, {GC_SQL}, {VOCABULARY_SQL}, c AS (SELECT family, codon, count(*) AS n FROM codon GROUP BY ALL),
    f AS (SELECT f.family, g.codon, g.aa, coalesce(n, 0) AS n FROM (SELECT DISTINCT family FROM c) f CROSS JOIN (SELECT * FROM gc WHERE translation_table = 1 AND aa <> '*') g LEFT JOIN c ON c.family = f.family AND c.codon = g.codon)
    SELECT family, codon, aa, round(coalesce(n / nullif(avg(n) OVER (PARTITION BY family, aa), 0), 1), 6) + 0.0 AS rscu FROM f""",
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return rscu(cds(spark, sf), "family")


def rscu(records: DataFrame, by: str) -> DataFrame:
    """(by, codon, aa, rscu): a codon's count over the mean of its synonyms; 1 where none is seen."""
    usage = codes.codon_usage(records.sparkSession).select("codon", "aa")
    n = codon_rows(records, by).groupBy(by, "codon").agg(F.count("*").alias("n"))
    every = n.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, sorted(codes.RSCU)))).alias("codon"))
    rows = every.join(n, [by, "codon"], "left").join(F.broadcast(usage), "codon").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = F.avg("n").over(Window.partitionBy(by, "aa"))
    return rows.select(by, "codon", "aa", r6(F.coalesce(F.col("n") / F.nullif(mean, F.lit(0.0)), F.lit(1.0))).alias("rscu"))


def adaptation(records: DataFrame, *keep: str) -> DataFrame:
    """(keep, cai, tai): geometric means of codon weights. CAI leaves out M, W and stops; tAI counts
    stops with 0.5. Both are 1 for nothing."""
    usage = codes.codon_usage(records.sparkSession)
    rows = codon_rows(records, *keep).join(F.broadcast(usage), "codon", "left")
    some = F.col("aa").isNotNull() & ~F.col("aa").isin("M", "W")
    out = rows.groupBy(*keep).agg(F.avg(F.when(some, F.log("w_cai"))).alias("c"), F.avg(F.log(F.coalesce("w_tai", F.lit(0.5)))).alias("t"))
    return out.select(*keep, r6(F.coalesce(F.exp("c"), F.lit(1.0))).alias("cai"), r6(F.coalesce(F.exp("t"), F.lit(1.0))).alias("tai"))


@query(
    "A17_A18_adaptation_indices",
    f"""WITH {CODONS_SQL}, {GC_SQL}, {USAGE_SQL}, w AS (SELECT codon, aa, greatest(0.01, rscu / max(rscu) OVER (PARTITION BY aa)) AS c, greatest(0.01, copies / max(copies) OVER ()) AS t FROM usage JOIN gc USING (codon) WHERE translation_table = 1)
    SELECT doc_id, round(coalesce(exp(avg(CASE WHEN aa NOT IN ('M', 'W') THEN ln(c) END)), 1), 6) + 0.0 AS cai, round(exp(avg(ln(coalesce(t, 0.5)))), 6) + 0.0 AS tai FROM codon LEFT JOIN w USING (codon) GROUP BY doc_id""",
)
def a17(spark: SparkSession, sf: str) -> DataFrame:
    return adaptation(cds(spark, sf), "doc_id")


def coverage_scores(cov: DataFrame, by: str, window: int = 9, least: float = 0.1) -> DataFrame:
    """(by, periodicity, peak, covered) of a positional series: share of frame 0, mean of the first
    window over the mean of the rest, share of places with `least` or more."""
    x, inside = F.col("x"), F.col("pos") < window
    s = cov.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum("x").alias("all"),
        F.sum(F.when(F.col("pos") % 3 == 0, x).otherwise(0.0)).alias("frame"),
        F.avg(F.when(inside, x)).alias("head"),
        F.avg(F.when(~inside, x)).alias("rest"),
        F.avg(F.when(x >= least, 1.0).otherwise(0.0)).alias("covered"),
    )
    periodicity = F.when((F.col("n") < 3) | (F.col("all") <= 0), 0.33).otherwise(F.col("frame") / F.col("all"))
    flat = F.when(F.col("head") > 0, F.col("head")).otherwise(1.0)
    peak = F.when(F.col("rest").isNull(), F.col("head")).when(F.col("rest") <= 0, flat).otherwise(F.col("head") / F.col("rest"))
    return s.select(by, r6(periodicity).alias("periodicity"), r6(peak).alias("peak"), r6(F.col("covered")).alias("covered"))


_SCORES = f"""{COVERAGE_SQL}, s AS (SELECT user_id, count(*) AS n, sum(x) AS a, sum(CASE WHEN pos % 3 = 0 THEN x ELSE 0 END) AS f, avg(CASE WHEN pos < 9 THEN x END) AS h, avg(CASE WHEN pos >= 9 THEN x END) AS r,
  avg(CASE WHEN x >= 0.1 THEN 1.0 ELSE 0 END) AS covered FROM cov GROUP BY user_id),
scores AS (SELECT user_id, CASE WHEN n < 3 OR a <= 0 THEN 0.33 ELSE f / a END AS periodicity, CASE WHEN r IS NULL THEN h WHEN r <= 0 THEN CASE WHEN h > 0 THEN h ELSE 1 END ELSE h / r END AS peak, covered FROM s)"""


@query("A19_A20_A21_coverage_scores", f"WITH {_SCORES} SELECT user_id, round(periodicity, 6) + 0.0 AS periodicity, round(peak, 6) + 0.0 AS peak, round(covered, 6) + 0.0 AS covered FROM scores")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return coverage_scores(coverage(spark, sf), "user_id")


@query(
    "A35_evidence_annotation",
    f"WITH {_SCORES} SELECT user_id, CASE WHEN round(periodicity, 6) >= 0.5 OR round(peak, 6) >= 2 OR round(covered, 6) >= 0.5 THEN 2 ELSE 4 END AS tier FROM scores",
)
def a35(spark: SparkSession, sf: str) -> DataFrame:
    from .gates import evidence_tier

    s = coverage_scores(coverage(spark, sf), "user_id")
    return s.select("user_id", evidence_tier(F.lit(False), F.col("periodicity"), F.col("peak"), F.col("covered"), F.lit(False)).alias("tier"))


@query(
    "A2_A3_grouping_sets",
    "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())",
)
def a3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "source", "n_chars")
    return docs.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "A22_A23_metric_buckets",
    """WITH e AS (SELECT l_returnflag, l_linestatus, sum(l_extendedprice * l_discount) AS nll, sum(l_quantity) AS tokens, count(*) FILTER (l_discount > 0.05) AS correct FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ()))
    SELECT l_returnflag, l_linestatus, round(nll / nullif(tokens, 0), 6) + 0.0 AS loss, correct, round(CASE WHEN l_returnflag IS NULL THEN (SELECT avg(nll / tokens) FROM e WHERE l_returnflag IS NOT NULL AND l_linestatus IS NULL) END, 6) + 0.0 AS macro FROM e""",
)
def a22(spark: SparkSession, sf: str) -> DataFrame:
    """Mergeable sums by several keys at once; the macro average is the mean of the families' ratios."""
    lines = table(spark, sf, "lineitem")
    sums = lines.groupingSets([["l_returnflag"], ["l_returnflag", "l_linestatus"], []], "l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("nll"), F.sum("l_quantity").alias("tokens"), F.count_if(F.col("l_discount") > 0.05).alias("correct")
    )
    loss = F.try_divide("nll", "tokens")
    family = F.col("l_returnflag").isNotNull() & F.col("l_linestatus").isNull()
    macro = F.avg(F.when(family, loss)).over(Window.partitionBy(F.lit(1)))  # a row for each of few buckets
    return sums.select("l_returnflag", "l_linestatus", r6(loss).alias("loss"), "correct", r6(F.when(F.col("l_returnflag").isNull(), macro)).alias("macro"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of w x over sum of w; the plain mean where the weights sum to zero."""
    return F.coalesce(F.try_divide(F.sum(w * x), F.nullif(F.sum(w), F.lit(0.0))), F.avg(x))


@query(
    "A24_weighted_mean",
    "SELECT l_returnflag, round(coalesce(sum(l_discount * l_extendedprice) / nullif(sum(l_discount), 0), avg(l_extendedprice)), 4) AS mean FROM lineitem GROUP BY 1",
)
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(weighted_mean(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("mean"))


@query(
    "A25_summary_statistics",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1",
)
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("sd")
    )


@query(
    "A26_report_pivot",
    "SELECT c_mktsegment AS arm, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS o, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def a26(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    joined = orders.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    out = joined.groupBy(F.col("c_mktsegment").alias("arm")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))
    return out.toDF("arm", "f", "o", "p")


@query(
    "A27_support_table",
    f"""WITH {CDS_SQL}, c AS (SELECT cohort, family, taxon, count(*) AS k, sum(length(rna)) AS bases FROM cds GROUP BY ALL)
    SELECT cohort, CAST(sum(k) AS BIGINT) AS n_cases, CAST(sum(bases) AS BIGINT) AS bases, string_agg(family || ':' || taxon || '=' || k, ',' ORDER BY family, taxon) AS support FROM c GROUP BY cohort""",
)
def a27(spark: SparkSession, sf: str) -> DataFrame:
    c = cds(spark, sf).groupBy("cohort", "family", "taxon").agg(F.count("*").alias("k"), F.sum(F.length("rna")).alias("bases"))
    each = F.struct("family", "taxon", "k")
    out = c.groupBy("cohort").agg(F.sum("k").alias("n_cases"), F.sum("bases").alias("bases"), F.sort_array(F.collect_list(each)).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["family"], F.lit(":"), x["taxon"], F.lit("="), x["k"])), ",")
    return out.select("cohort", "n_cases", "bases", text.alias("support"))


@query("A31_exposure", f"WITH {CDS_SQL} SELECT family, count(*) AS n_sequences, CAST(sum(length(rna) - 3) AS BIGINT) AS target_bases FROM cds GROUP BY family")
def a31(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).groupBy("family").agg(F.count("*").alias("n_sequences"), F.sum(F.length("rna") - 3).alias("target_bases"))


@query(
    "A36_charged_time",
    """WITH adj(user_id, idle) AS (VALUES (8, 5.0), (3, 2.5)), e AS (SELECT user_id, sum(value) AS elapsed FROM events GROUP BY 1)
    SELECT user_id, round(elapsed - coalesce(idle, 0), 6) + 0.0 AS charged FROM e LEFT JOIN adj USING (user_id)""",
)
def a36(spark: SparkSession, sf: str) -> DataFrame:
    adj = spark.createDataFrame([(8, 5.0), (3, 2.5)], "user_id long, idle double")
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("elapsed"))
    return e.join(F.broadcast(adj), "user_id", "left").select("user_id", r6(F.col("elapsed") - F.coalesce("idle", F.lit(0.0))).alias("charged"))


@query(
    "W12_support_labels",
    f"""WITH {CODONS_SQL}, c AS (SELECT family, pos, codon, count(*) AS n FROM codon WHERE cohort = 'training' GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY family, pos) AS most, sum(n) OVER (PARTITION BY family, pos) AS total FROM c),
    h AS (SELECT family, pos, codon, count(*) AS cases FROM codon WHERE cohort = 'holdout' GROUP BY ALL), s AS (SELECT DISTINCT family, pos FROM c)
    SELECT label, rare, CAST(sum(cases) AS BIGINT) AS n FROM (SELECT cases, CASE WHEN s.pos IS NULL THEN 'unsupported_position' WHEN m.n IS NULL THEN 'unobserved_codon' WHEN m.n = most THEN 'majority' ELSE 'observed_minority' END AS label,
      coalesce(m.n <= 0.01 * total, false) AS rare FROM h LEFT JOIN m USING (family, pos, codon) LEFT JOIN s USING (family, pos)) GROUP BY ALL""",
)
def w12(spark: SparkSession, sf: str) -> DataFrame:
    """How training supports the holdout's codons: all tied maxima are majority."""
    records = cds(spark, sf)
    seen = allele_counts(records.where("cohort = 'training'"), "family")
    at = Window.partitionBy("family", "pos")
    seen = seen.withColumns({"most": F.max("n").over(at), "total": F.sum("n").over(at)})
    places = seen.select("family", "pos").distinct().withColumn("supported", F.lit(True))
    cases = allele_counts(records.where("cohort = 'holdout'"), "family").withColumnRenamed("n", "cases")
    rows = cases.join(seen, ["family", "pos", "codon"], "left").join(places, ["family", "pos"], "left")
    label = F.when(F.col("supported").isNull(), "unsupported_position").when(F.col("n").isNull(), "unobserved_codon").when(F.col("n") == F.col("most"), "majority").otherwise("observed_minority")
    rare = F.coalesce(F.col("n") <= 0.01 * F.col("total"), F.lit(False))
    return rows.groupBy(label.alias("label"), rare.alias("rare")).agg(F.sum("cases").alias("n"))


@query(
    "A33_profile_describe",
    f"""WITH {CODONS_SQL}, v AS (SELECT family, taxon, pos, count(DISTINCT codon) > 1 AS variable FROM codon WHERE pos > 0 GROUP BY ALL)
    SELECT doc_id, count(*) FILTER (variable) AS n_variable, count(*) AS n FROM codon JOIN v USING (family, taxon, pos) GROUP BY doc_id""",
)
def a33(spark: SparkSession, sf: str) -> DataFrame:
    """Each record against its stratum's profile."""
    records = cds(spark, sf)
    rows = codon_rows(records, "doc_id", "family", "taxon").where("pos > 0").join(variable_positions(records), ["family", "taxon", "pos"])
    return rows.groupBy("doc_id").agg(F.count_if("variable").alias("n_variable"), F.count("*").alias("n"))


@query(
    "A9_base_entropy",
    f"""WITH {CDS_SQL}, b AS (SELECT family, unnest(string_split(rna, '')) AS base FROM cds), c AS (SELECT family, base, count(*) AS k FROM b GROUP BY ALL), p AS (SELECT family, k / sum(k) OVER (PARTITION BY family) AS p FROM c)
    SELECT family, round(-sum(p * log2(p)), 6) + 0.0 AS bits FROM p GROUP BY family""",
)
def a9_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Counted by length differences, without exploding a row a base."""
    n = lambda b: F.length("rna") - F.length(F.translate("rna", b, ""))
    sums = cds(spark, sf).groupBy("family").agg(*[F.sum(n(b)).alias(b) for b in codes.BASES], F.sum(F.length("rna")).alias("total"))
    bits = sum((entropy_bits(F.col(b) / F.col("total")) for b in codes.BASES), F.lit(0.0))
    return sums.select("family", r6(bits).alias("bits"))
