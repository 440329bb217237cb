"""Sequence records over the driver's tables: whole texts become coding-like RNA.

Each letter a-z becomes the base of its number modulo four; the whole text is used. Records carry
a family, a taxon, a genetic code, accessions and a cohort, as the operators expect them.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import codons

LETTERS = ascii_uppercase + ascii_lowercase
TO_BASES = "".join("ACGU"[k % 4] for k in range(26)) * 2


COHORT = "CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'training' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, rna, sequence_sha256, family, taxon, translation_table, accession, parent_accession, cohort)."""
    letters = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, TO_BASES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", letters.alias("raw")).where(F.length("raw") >= 6)
    rna = F.substring("raw", F.lit(1), F.length("raw") - F.length("raw") % 3)
    parent = F.when(F.col("doc_id") % 15 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    return docs.select("doc_id", "lang", "source", rna.alias("rna")).select(
        "doc_id",
        "rna",
        F.sha2("rna", 256).alias("sequence_sha256"),
        F.col("lang").alias("family"),
        F.col("source").alias("taxon"),
        F.when(F.col("lang") == "en", 1).otherwise(2).alias("translation_table"),
        F.concat(F.lit("D"), "doc_id", F.lit(".1")).alias("accession"),
        F.concat(F.lit("P"), parent, F.lit("."), F.col("doc_id") % 3 + 1).alias("parent_accession"),
        F.expr(COHORT).alias("cohort"),
    )


CDS_SQL = f"""raw AS (
  SELECT doc_id, lang, source, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{TO_BASES}') AS raw FROM documents
), cds AS (
  SELECT doc_id, rna, sha256(rna) AS sequence_sha256, lang AS family, source AS taxon, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS translation_table,
    'D' || doc_id || '.1' AS accession, 'P' || CASE WHEN doc_id % 15 = 0 THEN doc_id + 1 ELSE doc_id END || '.' || (doc_id % 3 + 1) AS parent_accession,
    CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'training' END AS cohort
  FROM (SELECT doc_id, lang, source, substr(raw, 1, length(raw) - length(raw) % 3) AS rna FROM raw WHERE length(raw) >= 6)
)"""


def sequences(records: DataFrame) -> DataFrame:
    """One row of each distinct sequence of a family and taxon, with how many records have it.

    Only short keys are grouped; the smallest doc_id stands for the sequence."""
    return records.groupBy("sequence_sha256", "family", "taxon").agg(
        F.count("*").alias("n_records"), F.min("doc_id").alias("doc_id"), F.min_by("rna", "doc_id").alias("rna"), F.min("translation_table").alias("translation_table")
    )


def fragments(spark: SparkSession, sf_dir: str, width: int, ends: bool = False) -> DataFrame:
    """(doc_id, family, taxon, cohort, rna, sequence_sha256): every record's whole sequence in runs of `width` bases; a
    shorter end is a fragment only where ends are asked for."""
    pieces = F.regexp_extract_all("rna", F.lit(f".{{{'1,' * ends}{width}}}"), F.lit(0))
    rows = cds(spark, sf_dir).select("doc_id", "family", "taxon", "cohort", F.explode(pieces).alias("rna"))
    return rows.withColumn("sequence_sha256", F.sha2("rna", 256))


def fragments_sql(width: int, ends: bool = False) -> str:
    return f"""{CDS_SQL}, frag AS (SELECT doc_id, family, taxon, cohort, rna, sha256(rna) AS sequence_sha256
  FROM (SELECT doc_id, family, taxon, cohort, unnest(regexp_extract_all(rna, '.{{{'1,' * ends}{width}}}')) AS rna FROM cds))"""


def codon_rows(records: DataFrame, *keep: str) -> DataFrame:
    """A row of each codon: keep, pos (from 0), codon."""
    return records.select(*keep, F.posexplode(codons(F.col("rna"))).alias("pos", "codon"))


CODONS_SQL = f"""{CDS_SQL}, split AS (SELECT * EXCLUDE (rna), regexp_extract_all(rna, '...') AS cs FROM cds
), codon AS (SELECT * EXCLUDE (cs), unnest(cs) AS codon, CAST(unnest(range(len(cs))) AS INTEGER) AS pos FROM split)"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos from 0, x): events of a user in order of time, as a positional series."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("x"))
    return positions(events, ["user_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"]).select("user_id", "pos", "x")


def positions(df: DataFrame, group: list[str], bucket: F.Column, order: list[str], weight: F.Column | None = None) -> DataFrame:
    """df with pos: how many rows (or what sum of weights) of its group stand before each row.

    bucket must not fall along the order. Rows are ranked within a bucket, and only the buckets'
    totals are added up over the group, so a hot group (or the whole table, with no group) is
    never sorted in one task."""
    rows = df.withColumns({"__b": bucket, "__w": F.lit(1).cast("long") if weight is None else weight})
    totals = rows.groupBy(*group, "__b").agg(F.sum("__w").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    same = F.col("__b").eqNullSafe(F.col("__c"))
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return rows.join(start, same).select(*df.columns, (F.col("__start") + F.col("__in")).alias("pos"))


COVERAGE_SQL = "cov AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, coalesce(value, 0) AS x FROM events)"
