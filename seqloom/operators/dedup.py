"""Deduplication by content with merged provenance, keyed upserts, ledgers and content stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.views import CDS_SQL, cds, table


def exact_dedup(df: DataFrame, key: F.Column, representative: str) -> DataFrame:
    """(key, representative, n): one row of each key with its smallest representative."""
    return df.groupBy(key.alias("key")).agg(F.min(representative).alias(representative), F.count("*").alias("n"))


@query(
    "A4_exact_dedup",
    f"WITH {CDS_SQL} SELECT md5(rna) AS key, min(accession) AS accession, count(*) AS n FROM cds GROUP BY 1",
)
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(cds(spark, sf), F.coalesce(F.nullif(F.md5("rna"), F.lit("")), "accession"), "accession")


def merge_provenance(records: DataFrame, priority: list[str]) -> DataFrame:
    """One row of each sequence: its taxa by panel priority, the first as primary, and how often it
    is found. Families or codes that disagree are marked as a conflict.

    Taxa are reduced to distinct (sequence, taxon) rows before any list is made, so a list is as long
    as the panel at most, whatever the number of copies."""
    order = F.create_map(*[F.lit(x) for k, t in enumerate(priority) for x in (t, k)]) if priority else F.map_from_arrays(F.array(), F.array()).cast("map<string,int>")
    pairs = records.groupBy("sequence_sha256", "taxon").agg(
        F.count("*").alias("n"), F.min("family").alias("f0"), F.max("family").alias("f1"), F.min("translation_table").alias("t0"), F.max("translation_table").alias("t1")
    )
    pairs = pairs.withColumn("place", F.coalesce(F.try_element_at(order, F.col("taxon")), F.lit(len(priority))))
    merged = pairs.groupBy("sequence_sha256").agg(
        F.sum("n").alias("n_records"),
        F.sort_array(F.collect_list(F.struct("place", "taxon"))).alias("taxa"),
        ((F.min("f0") != F.max("f1")) | (F.min("t0") != F.max("t1"))).alias("conflict"),
    )
    names = F.transform("taxa", lambda x: x["taxon"])
    return merged.select("sequence_sha256", "n_records", names[0].alias("primary_taxon"), F.array_join(names, ",").alias("taxa"), "conflict")


@query(
    "A5_provenance_merge",
    f"""WITH {CDS_SQL}, x AS (SELECT DISTINCT sequence_sha256, taxon, CASE taxon WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END AS place FROM cds),
    t AS (SELECT sequence_sha256, string_agg(taxon, ',' ORDER BY place, taxon) AS taxa FROM x GROUP BY 1),
    c AS (SELECT sequence_sha256, count(*) AS n_records, count(DISTINCT family) > 1 OR count(DISTINCT translation_table) > 1 AS conflict FROM cds GROUP BY 1)
    SELECT sequence_sha256, n_records, split_part(taxa, ',', 1) AS primary_taxon, taxa, conflict FROM c JOIN t USING (sequence_sha256)""",
)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return merge_provenance(cds(spark, sf), ["src3", "src1", "src2"])


@query("A6_distinct_bound", f"WITH {CDS_SQL} SELECT count(DISTINCT md5(rna)) AS bound, count(*) AS n FROM cds")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(cds(spark, sf), F.md5("rna"), "accession").agg(F.count("*").alias("bound"), F.sum("n").alias("n"))


@query(
    "A7_candidate_ranking",
    f"""WITH {CDS_SQL}, c AS (SELECT family, taxon, count(DISTINCT sequence_sha256) AS usable, count(*) AS n FROM cds GROUP BY ALL)
    SELECT family, taxon, usable, n, CAST(row_number() OVER (ORDER BY usable DESC, family, taxon) AS INTEGER) AS place FROM c""",
)
def a7(spark: SparkSession, sf: str) -> DataFrame:
    """Two aggregates with partial combining instead of a count of distinct values in one."""
    from pyspark.sql import Window

    one = cds(spark, sf).groupBy("family", "taxon", "sequence_sha256").agg(F.count("*").alias("n"))
    ranked = one.groupBy("family", "taxon").agg(F.count("*").alias("usable"), F.sum("n").alias("n"))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("usable"), "family", "taxon")))


@query(
    "K6_content_store",
    f"""WITH {CDS_SQL}, store AS (SELECT DISTINCT sequence_sha256 FROM cds WHERE cohort = 'training'), new AS (SELECT sequence_sha256, min(doc_id) AS doc_id FROM cds WHERE cohort = 'holdout' GROUP BY 1)
    SELECT sequence_sha256, doc_id FROM new WHERE sequence_sha256 NOT IN (SELECT sequence_sha256 FROM store)""",
)
def k6(spark: SparkSession, sf: str) -> DataFrame:
    records = cds(spark, sf).select("sequence_sha256", "doc_id", "cohort")
    new = records.where("cohort = 'holdout'").groupBy("sequence_sha256").agg(F.min("doc_id").alias("doc_id"))
    return missing_from(new, records.where("cohort = 'training'"), "sequence_sha256")


def missing_from(new: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """What an idempotent insert adds: rows whose key the store lacks."""
    return new.join(store.select(key).distinct(), key, "left_anti")


@query("K7_ledger_ids", f"WITH {CDS_SQL} SELECT doc_id, 'obs_' || substr(sequence_sha256, 1, 12) || '_' || accession AS observation_id FROM cds")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).select("doc_id", observation_id("sequence_sha256", "accession").alias("observation_id"))


def observation_id(sha: str, accession: str) -> F.Column:
    return F.concat(F.lit("obs_"), F.substring(sha, 1, 12), F.lit("_"), F.col(accession))


def upsert(store: DataFrame, updates: DataFrame, key: str, set_cols: list[str], last_col: str, order: str) -> DataFrame:
    """store with updates merged: set columns are united, last_col is that of the latest row by order.

    Elements of sets are first reduced to distinct (key, element) rows, so copies cost nothing."""
    rows = store.unionByName(updates)
    merged = rows.groupBy(key).agg(F.max_by(last_col, order).alias(last_col), F.count("*").alias("n_merged"))
    for c in set_cols:
        parts = rows.select(key, c).distinct().groupBy(key).agg(F.sort_array(F.collect_list(c)).alias(c))
        merged = merged.join(parts, key)
    return merged


@query(
    "K8_keyed_upsert",
    f"""WITH {CDS_SQL} SELECT sequence_sha256, array_to_string(list_sort(list(DISTINCT family)), ',') AS families, array_to_string(list_sort(list(DISTINCT taxon)), ',') AS taxa,
      max_by(accession, doc_id) AS accession, count(*) AS n_merged FROM cds GROUP BY 1""",
)
def k8(spark: SparkSession, sf: str) -> DataFrame:
    records = cds(spark, sf).select("sequence_sha256", "family", "taxon", "accession", "doc_id", "cohort")
    merged = upsert(records.where("cohort = 'training'"), records.where("cohort = 'holdout'"), "sequence_sha256", ["family", "taxon"], "accession", "doc_id")
    return merged.select("sequence_sha256", F.array_join("family", ",").alias("families"), F.array_join("taxon", ",").alias("taxa"), "accession", "n_merged")


@query("S11_ledger_scan", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "user_id", "event_type")


@query("S12_point_lookup", f"WITH {CDS_SQL} SELECT doc_id, family, taxon FROM cds WHERE sequence_sha256 = (SELECT min(sequence_sha256) FROM cds)")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    records = cds(spark, sf).select("doc_id", "family", "taxon", "sequence_sha256")
    return records.join(F.broadcast(records.agg(F.min("sequence_sha256").alias("sequence_sha256"))), "sequence_sha256").drop("sequence_sha256")


@query("S14_shard_scan", "SELECT count(*) AS n, count(DISTINCT lang) AS n_langs, sum(n_chars) AS chars FROM documents")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"), F.sum("n_chars").alias("chars"))


@query(
    "A29_set_digest",
    f"""WITH {CDS_SQL} SELECT family, sha256('["' || string_agg(DISTINCT taxon, '","' ORDER BY taxon) || '"]') AS digest, count(DISTINCT taxon) AS n FROM cds GROUP BY family""",
)
def a29(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 over the JSON array of the distinct values in order."""
    values = cds(spark, sf).select("family", "taxon").distinct().groupBy("family").agg(F.sort_array(F.collect_list("taxon")).alias("v"))
    return values.select("family", F.sha2(F.to_json("v"), 256).alias("digest"), F.size("v").cast("long").alias("n"))
