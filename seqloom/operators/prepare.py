"""Encoding a cohort in all modes: one pass writes a table for each mode, a manifest of order-free digests is checked before
use and written last, so a folder without one is no result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import sequence as S
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import CDS_SQL, cds
from .sampling import require

#: Tokens that a sequence needs in each mode: a first codon and something to predict.
LEAST = {"base": 4, "codon": 2}


def set_digest(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by, n, digest): a digest of rows as a set with repeats, whatever their order and partitioning: sums of four parts of
    each row's SHA-256, so it is one partial aggregate. Null is told from empty."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    h = F.sha2(F.concat_ws("|", *texts), 256)
    part = lambda k: F.sum(F.conv(F.substring("__h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.withColumn("__h", h).groupBy(*by).agg(F.count("*").alias("n"), *[F.coalesce(part(k), F.lit(0)).cast("string").alias(f"s{k}") for k in range(4)])
    return sums.select(*by, "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("digest"))


def encoded(records: DataFrame) -> DataFrame:
    """(mode, sequence_sha256, tokens, length): a row for each mode of each record, from one look at it."""
    bases = F.transform(F.split("rna", ""), lambda b: (F.instr(F.lit(codes.BASES), b) - 1).cast("tinyint"))
    triplets = F.transform(S.codons(F.col("rna")), lambda c: S.codon_index(c).cast("tinyint"))
    rows = records.select("sequence_sha256", F.explode(F.array(F.struct(F.lit("base").alias("mode"), bases.alias("tokens")), F.struct(F.lit("codon").alias("mode"), triplets.alias("tokens")))).alias("m"))
    return rows.select("m.mode", "sequence_sha256", "m.tokens", F.size("m.tokens").alias("length"))


def summary(rows: DataFrame) -> DataFrame:
    """(mode, sequences, tokens, longest, digest) of encoded rows."""
    text = rows.withColumn("text", F.array_join("tokens", ","))
    sizes = rows.groupBy("mode").agg(F.sum("length").alias("tokens"), F.max("length").alias("longest"))
    return set_digest(text, ["sequence_sha256", "text"], "mode").withColumnRenamed("n", "sequences").join(sizes, "mode").select("mode", "sequences", "tokens", "longest", "digest")


def prepare(records: DataFrame, folder: str, expected: str) -> DataFrame:
    """Writes records (sequence_sha256, rna) in all modes under `folder`, and the manifest (summary() with the cohort's digest).

    Raises if the cohort's digest is not the expected one, if it is empty or holds a sequence twice, or if a sequence is too
    short for a mode; nothing is written then. The manifest comes last: a run that is cut off leaves none."""
    scratch = Scratch(records.sparkSession, "prepare")
    rows = scratch.write(records.select("sequence_sha256", "rna"), "records")
    found = set_digest(rows, ["sequence_sha256", "rna"]).first()
    require([("the cohort has changed since its manifest", found.digest == expected)])
    twice = rows.groupBy("sequence_sha256").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    require([("the cohort is empty or holds a sequence twice", found.n > 0 and not twice)])
    clean = F.coalesce(F.col("rna").rlike("^[ACGU]+$") & (F.length("rna") % 3 == 0) & (F.length("rna") >= max(LEAST["base"], 3 * LEAST["codon"])), F.lit(False))
    require([("a sequence is no run of whole codons or too short", rows.where(~clean).limit(1).count() == 0)])
    encoded(rows).write.partitionBy("mode").parquet(f"{folder}/tokens")
    manifest = summary(records.sparkSession.read.parquet(f"{folder}/tokens")).withColumn("cohort_digest", F.lit(expected))
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")  # a row a mode
    return records.sparkSession.read.parquet(f"{folder}/manifest")


def open_prepared(spark: SparkSession, folder: str, mode: str, expected: str) -> DataFrame:
    """(sequence_sha256, tokens, length) of a mode, or ValueError if the manifest is missing, of another cohort, or not true."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    require([("there is no manifest: the preparation was cut off", path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))])
    listed = {r.mode: r for r in spark.read.parquet(f"{folder}/manifest").collect()}  # a row a mode
    require([("the manifest is of another cohort or has no such mode", mode in listed and listed[mode].cohort_digest == expected)])
    rows = spark.read.parquet(f"{folder}/tokens").where(F.col("mode") == mode)
    now = summary(rows).first()
    require([("the stored tokens differ from the manifest", now is not None and now.digest == listed[mode].digest)])
    return rows.select("sequence_sha256", "tokens", "length")


def _sum_sql(k: int) -> str:
    return f"CAST(sum(CAST('0x' || substr(h, {15 * k + 1}, 15) AS BIGINT)::HUGEINT) AS VARCHAR)"


@query(
    "K11_prepared_modes",
    f"""WITH {CDS_SQL}, u AS (SELECT DISTINCT sequence_sha256, rna FROM cds WHERE length(rna) >= 6),
    t AS (SELECT 'base' AS mode, sequence_sha256, list_transform(string_split(rna, ''), lambda b: instr('AUCG', b) - 1) AS tokens FROM u
      UNION ALL SELECT 'codon', sequence_sha256, list_transform(regexp_extract_all(rna, '...'), lambda c: 16 * (instr('AUCG', c[1]) - 1) + 4 * (instr('AUCG', c[2]) - 1) + instr('AUCG', c[3]) - 1) FROM u),
    h AS (SELECT mode, len(tokens) AS n, sha256('=' || sequence_sha256 || '|=' || array_to_string(tokens, ',')) AS h FROM t)
    SELECT mode, count(*) AS sequences, CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) AS INTEGER) AS longest, sha256(count(*) || ',' || {" || ',' || ".join(map(_sum_sql, range(4)))}) AS digest FROM h GROUP BY mode""",
)
def k11(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct sequence, prepared in both modes and opened again."""
    records = cds(spark, sf).where(F.length("rna") >= 6).groupBy("sequence_sha256").agg(F.first("rna").alias("rna"))
    records = Scratch(spark, "cohort").write(records, "records")
    expected = set_digest(records, ["sequence_sha256", "rna"]).first().digest
    folder = Scratch(spark, "prepared").root
    manifest = prepare(records, folder, expected)
    for mode in LEAST:
        open_prepared(spark, folder, mode, expected)
    return Scratch(spark, "manifest").write(manifest.drop("cohort_digest"), "rows")
