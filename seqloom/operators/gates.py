"""Quality gates: ordered rejection reasons, accumulating diagnostics, tiers and guards.

A gate adds a reason column: the first failing rule's name, or null for what passes. Accepted and
rejected rows are then plain filters, so no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import sequence as S
from ..functions.codes import GC_SQL
from ..registry import query
from ..sources.views import CDS_SQL, CODONS_SQL, cds, table


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that is true; a rule that is null counts as not met."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in rules])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Array of the names of all rules that are true."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in rules]))


def with_proteins(records: DataFrame) -> DataFrame:
    """Adds codon, start, stop and protein columns the gates look at."""
    t = F.col("translation_table")
    return records.withColumns({"protein": S.translate(F.col("rna"), t), "start_codon": F.substring("rna", 1, 3), "stop_codon": F.right("rna", F.lit(3))})


def cds_rules(max_aa: int) -> list[tuple[str, Column]]:
    t, inner = F.col("translation_table"), F.substring("protein", F.lit(2), F.length("protein") - 2)
    return [
        ("ambiguous_bases", ~F.col("rna").rlike("^[ACGU]+$")),
        ("incomplete_codon", F.length("rna") % 3 != 0),
        ("unexpected_genetic_code", ~t.isin(1, 2)),
        ("missing_start", ~S.is_start(F.col("start_codon"), t)),
        ("missing_stop", ~S.is_stop(F.col("stop_codon"), t)),
        ("internal_stop", inner.contains("*")),
        ("not_microprotein", F.length("protein") - 1 > max_aa),
    ]


_PROTEINS = f"""{CODONS_SQL}, {GC_SQL}, p AS (
  SELECT doc_id, string_agg(aa, '' ORDER BY pos) AS protein, bool_or(is_start AND pos = 0) AS s, max_by(is_stop, pos) AS e FROM codon JOIN gc USING (translation_table, codon) GROUP BY doc_id
)"""


@query(
    "P3_metadata_rejection",
    """SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN 'wrong_taxon' WHEN c_acctbal < 0 THEN 'partial_frame' WHEN nullif(nullif(nullif(lower(c_mktsegment), ''), 'false'), '0') = 'machinery' THEN 'flag_machinery' END AS reason
    FROM customer""",
)
def p3(spark: SparkSession, sf: str) -> DataFrame:
    truthy = ~F.lower("c_mktsegment").isin("", "false", "0")
    rules = [("wrong_taxon", F.col("c_nationkey") > 20), ("partial_frame", F.col("c_acctbal") < 0), ("flag_machinery", truthy & (F.lower("c_mktsegment") == "machinery"))]
    return table(spark, sf, "customer").select("c_custkey", first_reason(rules).alias("reason"))


@query(
    "P4_P5_complete_cds_gate",
    f"""WITH {_PROTEINS} SELECT doc_id, CASE WHEN NOT s THEN 'missing_start' WHEN NOT e THEN 'missing_stop' WHEN position('*' IN protein[2:-2]) > 0 THEN 'internal_stop'
      WHEN length(protein) - 1 > 100 THEN 'not_microprotein' END AS reason FROM p""",
)
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return with_proteins(cds(spark, sf)).select("doc_id", first_reason(cds_rules(100)).alias("reason"))


@query(
    "P6_parent_feature_gate",
    f"""WITH {CDS_SQL}, x AS (SELECT doc_id, family, rna, length(rna) // 6 * 3 AS half FROM cds)
    SELECT doc_id, CASE WHEN half < 6 THEN 'feature_too_short' WHEN family = 'de' AND substr(reverse(translate(rna, 'AUCG', 'UAGC')), 1, 3) NOT IN ('AUG', 'GUG', 'UUG') THEN 'minus_strand_start'
      WHEN family <> 'de' AND rna[1:3] NOT IN ('AUG', 'GUG', 'UUG') THEN 'plus_strand_start' END AS reason,
      md5(CASE WHEN family = 'de' THEN reverse(translate(rna, 'AUCG', 'UAGC'))[1:half] ELSE rna[1:half] END) AS feature_md5 FROM x""",
)
def p6(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of the parent's strand is the feature; 'de' parents are read on the other strand."""
    strand = F.when(F.col("family") == "de", F.reverse(F.translate("rna", "AUCG", "UAGC"))).otherwise(F.col("rna"))
    x = cds(spark, sf).select("doc_id", "family", strand.alias("strand"), (F.floor(F.length("rna") / 6) * 3).cast("int").alias("half"))
    bad = ~F.substring("strand", 1, 3).isin("AUG", "GUG", "UUG")
    rules = [("feature_too_short", F.col("half") < 6), ("minus_strand_start", (F.col("family") == "de") & bad), ("plus_strand_start", (F.col("family") != "de") & bad)]
    return x.select("doc_id", first_reason(rules).alias("reason"), F.md5(F.substring("strand", F.lit(1), F.col("half"))).alias("feature_md5"))


@query(
    "P7_record_identity",
    f"""WITH {_PROTEINS} SELECT doc_id, true AS alphabet_ok, true AS frame_ok, family IS NOT NULL AND family <> '' AS family_ok, s AS start_ok, e AS stop_ok, position('*' IN protein[2:-2]) = 0 AS body_ok
    FROM p JOIN cds USING (doc_id)""",
)
def p7(spark: SparkSession, sf: str) -> DataFrame:
    failed = dict(cds_rules(100))
    rows = with_proteins(cds(spark, sf))
    return rows.select(
        "doc_id",
        (~failed["ambiguous_bases"]).alias("alphabet_ok"),
        (~failed["incomplete_codon"]).alias("frame_ok"),
        (F.col("family").isNotNull() & (F.col("family") != "")).alias("family_ok"),
        (~failed["missing_start"]).alias("start_ok"),
        (~failed["missing_stop"]).alias("stop_ok"),
        (~failed["internal_stop"]).alias("body_ok"),
    )


@query(
    "P8_cds_diagnostics",
    f"""WITH {_PROTEINS} SELECT doc_id, concat_ws(',', CASE WHEN NOT s THEN 'missing_start' END, CASE WHEN NOT e THEN 'missing_stop' END,
      CASE WHEN position('*' IN protein[2:-2]) > 0 THEN 'internal_stop' END, CASE WHEN length(protein) - 1 > 100 THEN 'not_microprotein' END) AS reasons FROM p""",
)
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return with_proteins(cds(spark, sf)).select("doc_id", F.array_join(all_reasons(cds_rules(100)), ",").alias("reasons"))


@query(
    "P10_equal_length_identity",
    """SELECT p_partkey, p_brand, 'Brand#' || (1 + p_size % 5) AS expected, round(1 - hamming(p_brand, 'Brand#' || (1 + p_size % 5)) / length(p_brand), 6) + 0.0 AS identity
    FROM part WHERE length(p_brand) = length('Brand#' || (1 + p_size % 5))""",
)
def p10(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", F.concat(F.lit("Brand#"), F.col("p_size") % 5 + 1).alias("expected"))
    rows = rows.where(F.length("p_brand") == F.length("expected"))
    return rows.withColumn("identity", S.r6(1 - S.hamming(F.col("p_brand"), F.col("expected")) / F.length("p_brand")))


@query(
    "P11_quality_tier",
    f"""WITH {CDS_SQL}, x AS (SELECT doc_id, rna[1:3] AS c, quality, toxic FROM cds JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN c IN ('CUG', 'GUG', 'UUG', 'ACG') OR toxic = 1 THEN 3 WHEN quality = 1 THEN 1 ELSE 2 END AS tier,
      concat_ws('|', CASE WHEN c IN ('CUG', 'GUG', 'UUG', 'ACG') THEN 'near_cognate_start' END, CASE WHEN toxic = 1 THEN 'lead' END, CASE WHEN quality = 1 THEN 'reviewed' END) AS rationale FROM x""",
)
def p11(spark: SparkSession, sf: str) -> DataFrame:
    rows = cds(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    near, lead, reviewed = F.substring("rna", 1, 3).isin("CUG", "GUG", "UUG", "ACG"), F.col("toxic") == 1, F.col("quality") == 1
    why = all_reasons([("near_cognate_start", near), ("lead", lead), ("reviewed", reviewed)])
    return rows.select("doc_id", F.when(near | lead, 3).when(reviewed, 1).otherwise(2).alias("tier"), F.array_join(why, "|").alias("rationale"))


def evidence_tier(ms: Column, periodicity: Column, peak: Column, covered: Column, conserved: Column) -> Column:
    """1 with peptide evidence, 2 with any of three signs of translation, 3 if conserved, else 4."""
    active = (periodicity >= 0.5) | (peak >= 2.0) | (covered >= 0.5)
    return F.when(ms, 1).when(active, 2).when(conserved, 3).otherwise(4)


@query(
    "P12_P13_evidence_tier",
    """WITH u AS (SELECT user_id, bool_or(event_type = 'purchase') AS ms, avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0 END) AS covered, count(*) AS n FROM events GROUP BY user_id)
    SELECT user_id, tier, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.1 END::DOUBLE AS weight FROM (
      SELECT user_id, CASE WHEN ms THEN 1 WHEN covered >= 0.5 THEN 2 WHEN n >= 60 THEN 3 ELSE 4 END AS tier FROM u)""",
)
def p12(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("ms"), F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)).alias("covered"), F.count("*").alias("n")
    )
    none = F.lit(0.0)
    rows = u.select("user_id", evidence_tier(F.col("ms"), none, none, F.col("covered"), F.col("n") >= 60).alias("tier"))
    weights = F.create_map(*[F.lit(x) for kv in codes.TIER_WEIGHTS.items() for x in kv])
    return rows.withColumn("weight", F.element_at(weights, F.col("tier")))


@query(
    "P14_lineage_resolve",
    "SELECT s_suppkey, coalesce(r_name || ' > ' || n_name, 'unresolved') AS lineage FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def p14(spark: SparkSession, sf: str) -> DataFrame:
    """Lineages from a dimension of fixed size (nations and their regions), with a fallback."""
    lineage = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    lineage = lineage.select("n_nationkey", F.concat("r_name", F.lit(" > "), "n_name").alias("lineage"))
    rows = table(spark, sf, "supplier").join(lineage, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("s_suppkey", F.coalesce("lineage", F.lit("unresolved")).alias("lineage"))


@query(
    "P15_keyword_map",
    "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN 'mitochondrion' WHEN contains(lower(p_type), 'standard') THEN 'nucleus' WHEN contains(lower(p_type), 'promo') THEN 'membrane' ELSE 'other' END AS compartment FROM part",
)
def p15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", keyword_map(F.col("p_type"), {"economy": "mitochondrion", "standard": "nucleus", "promo": "membrane"}, "other").alias("compartment"))


def keyword_map(text: Column, keywords: dict[str, str], other: str) -> Column:
    """Value of the first keyword, in the order given, that the text contains."""
    return F.coalesce(*[F.when(F.lower(text).contains(k), F.lit(v)) for k, v in keywords.items()], F.lit(other))


@query("P16_compact_records", f"WITH {CDS_SQL} SELECT doc_id, sequence_sha256, family, taxon, translation_table FROM cds")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).select("doc_id", "sequence_sha256", "family", "taxon", "translation_table")


@query(
    "P17_term_and_range_filter",
    "SELECT page_id, length(html) AS n FROM pages WHERE (contains(lower(html), 'article') OR contains(lower(html), 'copyright')) AND length(html) BETWEEN 150 AND 100000 AND NOT length(html) BETWEEN 14000 AND 20000",
)
def p17(spark: SparkSession, sf: str) -> DataFrame:
    n, text = F.length("html"), F.lower("html")
    terms = text.contains("article") | text.contains("copyright")
    return table(spark, sf, "pages").where(terms & n.between(150, 100000) & ~n.between(14000, 20000)).select("page_id", n.cast("long").alias("n"))


@query(
    "P18_payload_budget",
    "SELECT count(*) AS n_rows, sum(length(html)) AS payload, count(*) <= 10000000 AND sum(length(html)) <= 100000000000 AS within FROM pages",
)
def p18(spark: SparkSession, sf: str) -> DataFrame:
    totals = table(spark, sf, "pages").agg(F.count("*").alias("n_rows"), F.sum(F.length("html")).alias("payload"))
    return totals.withColumn("within", (F.col("n_rows") <= 10_000_000) & (F.col("payload") <= 100_000_000_000))


@query(
    "P20_version_normalize",
    f"WITH {CDS_SQL} SELECT doc_id, CASE WHEN regexp_matches(a, '\\.\\d+$') THEN a ELSE a || '.1' END AS versioned FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN accession ELSE split_part(accession, '.', 1) END AS a FROM cds)",
)
def p20(spark: SparkSession, sf: str) -> DataFrame:
    a = F.when(F.col("doc_id") % 2 == 0, F.col("accession")).otherwise(F.split_part("accession", F.lit("."), F.lit(1)))
    return cds(spark, sf).select("doc_id", a.alias("a")).select("doc_id", F.when(F.col("a").rlike(r"\.\d+$"), F.col("a")).otherwise(F.concat("a", F.lit(".1"))).alias("versioned"))


@query(
    "P22_state_validation",
    "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (NOT (o_orderstatus IN ('F', 'O', 'P') AND isfinite(o_totalprice) AND o_totalprice >= 0)) AS n_bad FROM orders GROUP BY 1",
)
def p22(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_totalprice")
    good = F.col("o_orderstatus").isin("F", "O", "P") & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= 0)
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(~good).alias("n_bad"))


@query(
    "A1_rejection_histogram",
    f"""WITH {_PROTEINS}, r AS (SELECT family, CASE WHEN NOT s THEN 'missing_start' WHEN NOT e THEN 'missing_stop' WHEN position('*' IN protein[2:-2]) > 0 THEN 'internal_stop'
      WHEN length(protein) - 1 > 100 THEN 'not_microprotein' ELSE 'accepted' END AS reason FROM p JOIN cds USING (doc_id)) SELECT family, reason, count(*) AS n FROM r GROUP BY ALL""",
)
def a1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_proteins(cds(spark, sf)).select("family", F.coalesce(first_reason(cds_rules(100)), F.lit("accepted")).alias("reason"))
    return rows.groupBy("family", "reason").agg(F.count("*").alias("n"))
