"""Records with all their evidence in one row, and quality categories with the reasons for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.codes import GC_SQL, USAGE_SQL
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import CODONS_SQL, cds, coverage
from .feature_gates import _UNITS_SQL, units
from .gates import evidence_tier
from .profiles import _SCORES, adaptation, coverage_scores

#: Scores of a record without coverage.
NO_COVERAGE = {"periodicity": 0.33, "peak": 1.0, "covered": 0.0}


def annotate(records: DataFrame, series: DataFrame) -> DataFrame:
    """records (id, rna, series_id, has_ms, is_conserved) with cai, tai, periodicity, peak, covered and evidence_tier.

    series: (series_id, pos from 0, x), positional coverage; a record without any has the scores of NO_COVERAGE. Null flags
    are false; ids may repeat, their codons are then one record's. The indices and the series are grouped sums, so a long
    record or series is never gathered."""
    scratch = Scratch(records.sparkSession, "annotate")
    rows = scratch.write(records.select("id", "rna", "series_id", "has_ms", "is_conserved"), "records")
    indices = adaptation(rows.select("id", "rna"), "id")
    scores = coverage_scores(series, "series_id")
    out = rows.drop("rna").join(indices, "id", "left").join(scores, "series_id", "left")
    out = out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in NO_COVERAGE.items()}).withColumns({k: F.coalesce(k, F.lit(1.0)) for k in ("cai", "tai")})
    yes = lambda c: F.coalesce(c, F.lit(False))
    tier = evidence_tier(yes(F.col("has_ms")), F.col("periodicity"), F.col("peak"), F.col("covered"), yes(F.col("is_conserved")))
    return out.select("id", "cai", "tai", *NO_COVERAGE, tier.alias("evidence_tier"))


@query(
    "A35_record_annotation",
    f"""WITH {CODONS_SQL}, {GC_SQL}, {USAGE_SQL}, {_SCORES}, w AS (SELECT codon, aa, greatest(0.01, rscu / max(rscu) OVER (PARTITION BY aa)) AS c, greatest(0.01, copies / max(copies) OVER ()) AS t FROM usage JOIN gc USING (codon) WHERE translation_table = 1),
    ix AS (SELECT doc_id, round(coalesce(exp(avg(CASE WHEN aa NOT IN ('M', 'W') THEN ln(c) END)), 1), 6) + 0.0 AS cai, round(exp(avg(ln(coalesce(t, 0.5)))), 6) + 0.0 AS tai FROM codon LEFT JOIN w USING (codon) GROUP BY doc_id),
    a AS (SELECT doc_id AS id, cai, tai, coalesce(round(periodicity, 6) + 0.0, 0.33) AS periodicity, coalesce(round(peak, 6) + 0.0, 1.0) AS peak, coalesce(round(covered, 6) + 0.0, 0.0) AS covered FROM ix LEFT JOIN scores ON user_id = doc_id)
    SELECT id, cai, tai, CAST(periodicity AS DOUBLE) AS periodicity, CAST(peak AS DOUBLE) AS peak, CAST(covered AS DOUBLE) AS covered,
      CASE WHEN id % 11 = 0 THEN 1 WHEN periodicity >= 0.5 OR peak >= 2 OR covered >= 0.5 THEN 2 WHEN id % 3 = 0 THEN 3 ELSE 4 END AS evidence_tier FROM a""",
)
def a35_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole records; the events of the user with a record's number are its coverage, other records have none."""
    records = cds(spark, sf).select(F.col("doc_id").alias("id"), "rna", F.col("doc_id").alias("series_id"), (F.col("doc_id") % 11 == 0).alias("has_ms"), (F.col("doc_id") % 3 == 0).alias("is_conserved"))
    return annotate(records, coverage(spark, sf).withColumnRenamed("user_id", "series_id"))


TIERS = {1: "Tier 1 (Gold/Swiss-Prot)", 2: "Tier 2 (Genomic CDS)", 3: "Tier 3 (sORF leads)"}
NEAR_COGNATE = ("CUG", "GUG", "UUG", "ACG")


def quality_category(records: DataFrame) -> DataFrame:
    """records (protein, initiation_codon, initiation_type, identity, is_lead, reviewed, impi_class, uniprot) with tier,
    tier_name and rationale (an array).

    A reference is curated if it is reviewed, verified, or its accession begins with P, Q or O. Curated, an identity of 0.95 or
    more and a canonical start make tier 1; a near-cognate start or a lead tier 3; the rest is tier 2, or 1 if curated with that
    identity. Null identities count as 0, null flags as false, null proteins have no letters."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    curated = F.coalesce("reviewed", F.lit(False)) | blank(F.col("impi_class")).startswith("Verified") | blank(F.col("uniprot")).rlike("^[PQO]")
    identity = F.coalesce("identity", F.lit(0.0))
    shown = F.concat(F.lit(" ("), F.round(identity, 3).cast("decimal(12,3)").cast("string"), F.lit(")"))
    near, high = F.coalesce((F.col("initiation_type") == "near_cognate") | F.col("initiation_codon").isin(*NEAR_COGNATE) | F.col("is_lead"), F.lit(False)), identity >= 0.95
    canonical = blank(F.col("initiation_type")) == "canonical"
    gold = curated & high & canonical
    start, size = F.concat(F.lit(" ("), blank(F.col("initiation_codon")), F.lit(")")), F.concat(F.lit(" ("), F.coalesce(F.length("protein"), F.lit(0)).cast("string"), F.lit(" aa)"))
    line = lambda text, *more: F.concat(F.lit(text), *more)
    first = F.array(F.lit("Swiss-Prot/IMPI verified reference"), line("High reference identity", shown), line("Canonical initiation codon", start), F.lit("Complete verified CDS"))
    third = F.array_compact(F.array(line("Non-canonical initiation codon", start), line("sORF candidate microprotein", size), F.when(~curated, "Uncharacterized sORF prediction lead")))
    second = F.array_compact(F.array(F.lit("Standard annotated genomic CDS feature"), line("Valid reading frame", size), line("Reference identity", shown), F.when(curated, "Curated gene family candidate")))
    tier = F.when(gold, 1).when(near, 3).when(curated & high, 1).otherwise(2)
    names = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    return records.withColumns({"tier": tier, "tier_name": F.element_at(names, tier), "rationale": F.when(gold, first).when(near, third).otherwise(second)})


@query(
    "P11_quality_categories",
    f"""WITH {_UNITS_SQL}, x AS (SELECT id, CASE WHEN d % 5 = 0 THEN 'GUG' WHEN d % 7 = 0 THEN 'AUU' ELSE 'AUG' END AS c, CASE WHEN d % 5 = 0 THEN 'near_cognate' WHEN d % 7 = 0 THEN 'invalid' ELSE 'canonical' END AS t,
      CASE WHEN d = 3 THEN NULL ELSE e / 32 + 0.05 END AS i, d % 11 = 0 AS lead, e % 2 = 0 OR d % 4 = 1 OR d % 9 = 2 AS curated FROM unit),
    y AS (SELECT *, curated AND coalesce(i, 0) >= 0.95 AND t = 'canonical' AS gold, t = 'near_cognate' OR lead AS near, ' (' || format('{{:.3f}}', round(coalesce(i, 0), 3)) || ')' AS shown FROM x)
    SELECT id, CASE WHEN gold THEN 1 WHEN near THEN 3 WHEN curated AND coalesce(i, 0) >= 0.95 THEN 1 ELSE 2 END AS tier,
      CASE WHEN gold THEN '{TIERS[1]}' WHEN near THEN '{TIERS[3]}' WHEN curated AND coalesce(i, 0) >= 0.95 THEN '{TIERS[1]}' ELSE '{TIERS[2]}' END AS tier_name,
      CASE WHEN gold THEN 'Swiss-Prot/IMPI verified reference|High reference identity' || shown || '|Canonical initiation codon (' || c || ')|Complete verified CDS'
        WHEN near THEN 'Non-canonical initiation codon (' || c || ')|sORF candidate microprotein (37 aa)' || CASE WHEN curated THEN '' ELSE '|Uncharacterized sORF prediction lead' END
        ELSE 'Standard annotated genomic CDS feature|Valid reading frame (37 aa)|Reference identity' || shown || CASE WHEN curated THEN '|Curated gene family candidate' ELSE '' END END AS rationale FROM y""",
)
def p11_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Coding sequences of every run of each record, with starts, identities and references by their numbers."""
    u = units(spark, sf).withColumn("protein", S.translate_cds(F.translate("cds", "T", "U"), F.col("expected_table")))
    d, e = F.col("d"), F.col("e")
    rows = u.select(
        "id", "protein", F.when(d % 5 == 0, "GUG").when(d % 7 == 0, "AUU").otherwise("AUG").alias("initiation_codon"), F.when(d % 5 == 0, "near_cognate").when(d % 7 == 0, "invalid").otherwise("canonical").alias("initiation_type"),
        F.when(d != 3, e / 32 + 0.05).alias("identity"), F.when(d % 11 == 0, True).alias("is_lead"), F.when(e % 2 == 0, True).alias("reviewed"), F.when(d % 4 == 1, "Verified mitochondrial").otherwise("Predicted").alias("impi_class"),
        F.when(d % 9 == 2, "Q9Y6H1").when(d % 9 == 3, "A0A0").alias("uniprot"),
    )
    return quality_category(rows).select("id", "tier", "tier_name", F.array_join("rationale", "|").alias("rationale"))
