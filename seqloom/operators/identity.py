"""Identity of records and strict verification of a holdout: checks in order, as reasons, and a guard that raises on the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..plans.storage import Scratch
from ..registry import query
from .feature_gates import _UNITS_SQL, MOTIF, units
from .gates import first_reason

#: Checks of one record in their order, then those of a cohort.
IDENTITY = (
    "incomplete_codons", "checksum_mismatch", "empty_family", "invalid_taxon", "unsupported_code", "family_code_mismatch",
    "incomplete_cds", "internal_stop", "not_microprotein", "invalid_taxa", "taxon_not_in_taxa",
)
HOLDOUT = ("duplicate_rna", "taxon_not_allowed", "family_not_allowed", "training_rna", "no_provenance", "source_overlap")


def record_identity(records: DataFrame, codes: dict[str, int], default_code: int, families_of_genes: dict[str, str], max_aa: int = 100) -> DataFrame:
    """records (rna, sequence_sha256, family, gene, tax_id, translation_table, taxa) with family filled from the gene where it is
    blank and known, and reason: the first check of IDENTITY that fails, null if none does.

    codes: the genetic code of each family, default_code of the others. A null that a check needs fails it; a null list of
    taxa is not checked, an empty one lacks the taxon."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    pairs = [F.lit(x) for kv in families_of_genes.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), F.col("gene")) if pairs else F.lit(None)
    rows = records.withColumn("family", F.when(F.length(F.trim(F.coalesce("family", F.lit("")))) > 0, F.col("family")).otherwise(known))
    code = F.coalesce(*[F.when(F.col("family") == f, c) for f, c in codes.items()], F.lit(default_code))
    table = F.when(F.col("translation_table").isin(1, 2), F.col("translation_table")).otherwise(1)
    triplets = S.codons(F.col("rna"))
    inner = F.slice(triplets, F.lit(2), F.greatest(F.size(triplets) - 2, F.lit(0)))
    rules = [
        no((F.length("rna") >= 6) & (F.length("rna") % 3 == 0) & F.col("rna").rlike("^[ACGU]+$")),
        no(F.sha2("rna", 256) == F.col("sequence_sha256")),
        F.col("family").isNull(),
        no(F.col("tax_id") >= 1),
        no(F.col("translation_table").isin(1, 2)),
        no(F.col("translation_table") == code),
        no(S.is_start(F.substring("rna", 1, 3), table) & S.is_stop(F.right("rna", F.lit(3)), table)),
        F.exists(inner, lambda c: S.is_stop(c, table)),
        F.size(triplets) - 1 > max_aa,
        F.coalesce(F.exists("taxa", lambda t: ~F.coalesce(t >= 1, F.lit(False))), F.lit(False)),
        F.coalesce(~F.array_contains("taxa", F.col("tax_id")), F.lit(False)),
    ]
    return rows.withColumn("reason", first_reason(list(zip(IDENTITY, rules, strict=True))))


def verify_holdout(records: DataFrame, training: DataFrame, allowed_taxa: list[int], allowed_families: list[str]) -> DataFrame:
    """(id, reason) of each record that record_identity() has judged, against training records judged likewise: its own reason,
    else the first of HOLDOUT. records and training hold id, rna's digest, family, tax_id, taxa, accessions (an array, with
    versions) and reason.

    A sequence twice in the cohort marks both; accessions compare without version and case; null accessions are none. Only
    distinct digests and names move, so no copy or source meets in one task."""
    scratch = Scratch(records.sparkSession, "holdout")
    named = lambda rows: F.array_distinct(F.filter(F.transform(F.coalesce("accessions", F.array().cast("array<string>")), S.stable_accession), lambda a: F.length(a) > 0))
    rows = scratch.write(records.select("id", "sequence_sha256", "family", "tax_id", "taxa", named(records).alias("names"), F.col("reason").alias("own")), "records")
    known = training.select("sequence_sha256").distinct().withColumn("known", F.lit(True))
    twice = rows.groupBy("sequence_sha256").agg((F.count("*") > 1).alias("twice")).where("twice")
    sources = training.select(F.explode(named(training)).alias("name")).distinct()
    shared = rows.select("id", F.explode("names").alias("name")).join(sources, "name", "left_semi").select("id").distinct().withColumn("shared", F.lit(True))
    outside = ~F.col("tax_id").isin(allowed_taxa) | F.exists(F.coalesce("taxa", F.array("tax_id")), lambda t: ~t.isin(allowed_taxa))
    rules = [F.col("twice"), outside, ~F.col("family").isin(allowed_families), F.col("known"), F.size("names") == 0, F.col("shared")]
    rows = rows.join(twice, "sequence_sha256", "left").join(known, "sequence_sha256", "left").join(shared, "id", "left")
    return rows.select("id", F.coalesce("own", first_reason(list(zip(HOLDOUT, rules, strict=True)))).alias("reason"))


def require_valid(judged: DataFrame, what: str) -> DataFrame:
    """judged (with reason) without that column; raises ValueError, naming the first failing check and how many rows fail it.
    An empty table fails too: there is nothing to verify."""
    n = {r.reason: r.n for r in judged.groupBy("reason").agg(F.count("*").alias("n")).collect()}  # a row a reason
    if not n:
        raise ValueError(f"{what}: no records")
    for reason in (*IDENTITY, *HOLDOUT):
        if reason in n:
            raise ValueError(f"{what}: {reason} ({n[reason]} records)")
    return judged.drop("reason")


CODES, GENES = {"en": 1}, {f"{lang.upper()}-1": lang for lang in ("de", "en", "es", "fr")}
#: The check that a defect's number must fail; others pass.
DEFECTS = {
    0: "incomplete_codons", 1: "incomplete_codons", 2: "incomplete_codons", 3: "incomplete_codons", 4: "checksum_mismatch", 5: "empty_family", 7: "invalid_taxon", 8: "unsupported_code",
    9: "family_code_mismatch", 10: "incomplete_cds", 11: "incomplete_cds", 12: "internal_stop", 13: "not_microprotein", 14: "invalid_taxa", 15: "taxon_not_in_taxa", 17: "taxon_not_in_taxa",
}


def identity_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with planted defects: the number d spoils what DEFECTS says."""
    u, d = units(spark, sf), F.col("d")
    rna = F.translate("cds", "T", "U")
    long = F.concat(F.lit("AUG"), F.translate(F.repeat(F.concat("body", F.lit(MOTIF)), F.lit(3)), "T", "U"), F.lit("UAA"))
    spoiled = (
        F.when(d == 0, F.lit(None)).when(d == 1, "AUG").when(d == 2, F.expr("substring(translate(cds, 'T', 'U'), 1, length(cds) - 1)")).when(d == 3, F.overlay(rna, F.lit("N"), F.lit(9)))
        .when(d == 10, F.overlay(rna, F.lit("CCC"), F.lit(1))).when(d == 11, F.concat(F.expr("substring(translate(cds, 'T', 'U'), 1, length(cds) - 3)"), F.lit("CCC")))
        .when(d == 12, F.overlay(rna, F.lit("UAA"), F.lit(7))).when(d == 13, long).otherwise(rna)
    )
    tax = F.when(d == 7, 0).otherwise(F.col("e") + 1).cast("int")
    table = F.when(d == 8, 4).when(d == 9, 3 - F.col("expected_table")).otherwise(F.col("expected_table"))
    taxa = F.when(d == 14, F.array(tax, F.lit(0))).when(d == 15, F.array(tax + 1)).when(d == 17, F.array().cast("array<int>")).when(d != 16, F.array(F.lit(1), tax))
    return u.select(
        "id", spoiled.alias("rna"), F.sha2(F.when(d == 4, F.lit("x")).otherwise(spoiled), 256).alias("sequence_sha256"), F.when(d.isin(5, 6), " ").otherwise(F.col("family")).alias("family"),
        F.when(d == 5, "other").otherwise(F.concat(F.upper("family"), F.lit("-1"))).alias("gene"), tax.alias("tax_id"), table.alias("translation_table"), taxa.alias("taxa"), "d", "e",
        F.when(F.col("e") % 7 == 0, F.array().cast("array<string>")).when(F.col("e") % 3 == 0, F.array(F.concat("id", F.lit(".1")), F.concat(F.lit("p"), "e", F.lit("."), "d"))).otherwise(F.array(F.concat("id", F.lit(".1")))).alias("accessions"),
    )


_CASE = "CASE d " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in DEFECTS.items()) + " END"


@query("P7_identity_checks", f"WITH {_UNITS_SQL} SELECT id, family, {_CASE} AS reason FROM (SELECT id, CASE WHEN d = 5 THEN NULL ELSE family END AS family, d FROM unit)")
def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    return record_identity(Scratch(spark, "identity").write(identity_records(spark, sf), "records"), CODES, 2, GENES).select("id", "family", "reason")


@query(
    "J7_holdout_checks",
    f"""WITH {_UNITS_SQL}, r AS (SELECT id, CASE WHEN d = 5 THEN NULL ELSE family END AS family, d, e, {_CASE} AS own, e + 1 AS tax,
      CASE WHEN e % 7 = 0 THEN [] WHEN e % 3 = 0 THEN [upper(id), 'P' || e] ELSE [upper(id)] END AS names,
      CASE d WHEN 0 THEN NULL WHEN 1 THEN 'AUG' WHEN 2 THEN cds[1:-2] WHEN 13 THEN NULL ELSE cds || CASE WHEN d IN (3, 10, 11, 12) THEN d::VARCHAR ELSE '' END END AS s FROM unit),
    ho AS (SELECT * FROM r WHERE (e * 3 + d) % 5 = 0), tr AS (SELECT * FROM r WHERE (e * 3 + d) % 5 <> 0),
    trs AS (SELECT DISTINCT s FROM tr WHERE own IS NULL), trn AS (SELECT DISTINCT unnest(names) AS name FROM tr WHERE own IS NULL), n AS (SELECT s, count(*) AS n FROM ho WHERE s IS NOT NULL AND own IS NULL GROUP BY s)
    SELECT id, coalesce(own, CASE WHEN n.n > 1 THEN 'duplicate_rna' WHEN tax > 24 THEN 'taxon_not_allowed' WHEN family NOT IN ('en', 'de', 'fr') THEN 'family_not_allowed'
      WHEN s IN (SELECT s FROM trs) THEN 'training_rna' WHEN len(names) = 0 THEN 'no_provenance' WHEN id IN (SELECT id FROM (SELECT id, unnest(names) AS name FROM ho) WHERE name IN (SELECT name FROM trn)) THEN 'source_overlap' END) AS reason
    FROM ho LEFT JOIN n USING (s)""",
)
def j7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the records against the valid ones of the rest; verification would raise on the first reason."""
    rows = Scratch(spark, "identity").write(identity_records(spark, sf), "records")
    judged = Scratch(spark, "judged").write(record_identity(rows, CODES, 2, GENES), "judged")
    out = (F.col("e") * 3 + F.col("d")) % 5 == 0
    # copies that fail a check of their own are no members of the cohort
    held = judged.where(out)
    good = verify_holdout(held.where("reason IS NULL"), judged.where(~out & F.col("reason").isNull()), list(range(1, 25)), ["en", "de", "fr"])
    return good.unionByName(held.where("reason IS NOT NULL").select("id", "reason"))
