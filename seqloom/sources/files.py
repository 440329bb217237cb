"""Readers and writers of the formats that sequence records come in.

All of them are Spark readers: files are split and parsed on the executors, paths may be on any
store that Spark reads, and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locations


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines left out; the schema is given, not inferred."""
    return spark.read.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str], expected_rows: int | None = None) -> DataFrame:
    """A tab-separated index with a header, every column a string. With expected_rows, a different
    number of rows raises an error when the result is read."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, enforceSchema=False)
    if expected_rows is None:
        return df
    n = df.agg(F.count("*").alias("__n"))
    fail = F.raise_error(F.lit(f"the index should have {expected_rows} rows")).cast("boolean")
    return df.join(F.broadcast(n.select(F.when(F.col("__n") == expected_rows, True).otherwise(fail).alias("__ok")))).where("__ok").drop("__ok")


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """(id, length, description, accession, protein_id, translation, sequence) of EMBL flat files.

    A record ends with //, which is the reader's line separator, so large files are split."""
    rows = spark.read.option("lineSep", "\n//").text(path).where(F.length(F.trim("value")) > 0)
    value = F.concat(F.lit("\n"), "value")
    joined = lambda tag: F.array_join(F.regexp_extract_all(value, F.lit(rf"\n{tag}   ([^\n]*)"), F.lit(1)), " ")
    features = F.regexp_replace(joined("FT"), r"\s+", " ")
    body = F.regexp_extract(value, r"\nSQ [^\n]*\n([\s\S]*)", 1)
    none = lambda x: F.nullif(x, F.lit(""))
    return rows.select(
        F.regexp_extract(value, r"\nID\s+([^;\s]+)", 1).alias("id"),
        F.regexp_extract(value, r"\nID[^\n]*?(\d+) BP", 1).cast("int").alias("length"),
        none(joined("DE")).alias("description"),
        none(F.regexp_extract(value, r"\nAC\s+([^;\s]+)", 1)).alias("accession"),
        none(F.regexp_extract(features, r'/protein_id="([^"]*)"', 1)).alias("protein_id"),
        none(F.regexp_replace(F.regexp_extract(features, r'/translation="([^"]*)"', 1), " ", "")).alias("translation"),
        F.upper(F.regexp_replace(body, r"[^A-Za-z]", "")).alias("sequence"),
    ).where("id <> ''")


def read_embl_features(spark: SparkSession, path: str) -> DataFrame:
    """(id, ordinal, key, location, parts, qualifiers, bases) with a row for each feature of EMBL flat files, in order.

    parts: the location's ordered parts (functions.locations), null for what is none; qualifiers: a map of each name's values
    in order, an empty text for one without a value; white space of wrapped values is one space, and none in translations.
    bases: the feature's sequence, null for a part of another record or outside this one. A record without features has no row."""
    rows = spark.read.option("lineSep", "\n//").text(path).where(F.length(F.trim("value")) > 0)
    value = F.concat(F.lit("\n"), "value")
    table = F.concat(F.lit("\n"), F.array_join(F.regexp_extract_all(value, F.lit(r"\nFT   ([^\n]*)"), F.lit(1)), "\n"))
    rows = rows.select(
        F.regexp_extract(value, r"\nID\s+([^;\s]+)", 1).alias("id"), F.upper(F.regexp_replace(F.regexp_extract(value, r"\nSQ [^\n]*\n([\s\S]*)", 1), r"[^A-Za-z]", "")).alias("sequence"),
        F.posexplode(F.filter(F.split(table, r"\n(?=\S)"), lambda x: x.rlike(r"\S"))).alias("ordinal", "text"),
    ).where("id <> ''")
    lines = F.split("text", r"\n\s+(?=/)")
    head, tail = F.get(lines, 0), F.slice(lines, F.lit(2), F.size(lines))
    rows = rows.withColumns({"key": F.regexp_extract(head, r"^(\S+)", 1), "location": F.regexp_replace(F.regexp_replace(head, r"^\S+\s+", ""), r"\s+", ""), "tail": tail})
    name = lambda q: F.regexp_extract(q, r"^/([^=\s]+)", 1)
    plain = lambda q: F.regexp_replace(F.regexp_replace(F.when(q.contains("="), F.regexp_replace(q, r"^/[^=]+=", "")).otherwise(""), r'^"|"$', ""), r"\s+", " ")
    cleaned = lambda q: F.when(name(q) == "translation", F.regexp_replace(plain(q), " ", "")).otherwise(plain(q))
    names = F.array_distinct(F.transform("tail", name))
    values = F.transform(names, lambda n: F.transform(F.filter("tail", lambda q: name(q) == n), cleaned))
    rows = rows.withColumns({"qualifiers": F.map_from_arrays(names, values), "parts": locations.parts(F.col("location"))})
    here = F.coalesce(~F.exists("parts", lambda p: p["remote"] | (p["first"] < 1) | (p["last"] > F.length("sequence")) | (p["first"] > p["last"])), F.lit(False))
    return rows.select("id", "ordinal", "key", "location", "parts", "qualifiers", F.when(here, locations.extract(F.col("sequence"), F.col("parts"))).alias("bases"))


def requested_records(records: DataFrame, requested: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """records as they are, and the requested keys that have none. Raises ValueError if a key comes twice or was not asked for."""
    seen = records.groupBy(key).agg(F.count("*").alias("n")).join(requested.select(key).distinct().withColumn("asked", F.lit(True)), key, "left")
    twice, other = seen.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("asked").isNull())).first()
    if twice or other:
        raise ValueError(f"{twice} records come twice, {other} were not requested")
    return records, requested.select(key).distinct().join(records.select(key), key, "left_anti")


INSDSEQ = """
`INSDSeq_accession-version` string, INSDSeq_length int, INSDSeq_organism string, INSDSeq_sequence string,
`INSDSeq_feature-table` struct<INSDFeature: array<struct<INSDFeature_key: string, INSDFeature_location: string,
  INSDFeature_quals: struct<INSDQualifier: array<struct<INSDQualifier_name: string, INSDQualifier_value: string>>>>>>
"""


def read_insdseq(spark: SparkSession, path: str) -> DataFrame:
    """(accession, length, organism, sequence, key, location, qualifiers map) with a row a feature."""
    df = spark.read.format("xml").option("rowTag", "INSDSeq").schema(INSDSEQ).load(path)
    rows = df.select(
        F.col("INSDSeq_accession-version").alias("accession"),
        F.col("INSDSeq_length").alias("length"),
        F.col("INSDSeq_organism").alias("organism"),
        F.upper("INSDSeq_sequence").alias("sequence"),
        F.explode_outer(F.col("`INSDSeq_feature-table`.INSDFeature")).alias("f"),
    )
    quals = F.col("f.INSDFeature_quals.INSDQualifier")
    names = F.array_distinct(F.transform(quals, lambda q: q["INSDQualifier_name"]))
    of = lambda name: F.transform(F.filter(quals, lambda q: q["INSDQualifier_name"] == name), lambda q: q["INSDQualifier_value"])
    return rows.select(
        "accession", "length", "organism", "sequence", F.col("f.INSDFeature_key").alias("key"), F.col("f.INSDFeature_location").alias("location"), F.map_from_arrays(names, F.transform(names, of)).alias("qualifiers")
    )


def flatten_cross_references(entries: DataFrame, database: str = "EMBL") -> DataFrame:
    """(accession, tax_id, id, protein_id) of JSON protein entries' references to one database."""
    refs = F.filter("uniProtKBCrossReferences", lambda r: r["database"] == database)
    rows = entries.select(F.col("primaryAccession").alias("accession"), F.col("organism.taxonId").alias("tax_id"), F.explode(refs).alias("r"))
    protein = F.filter("r.properties", lambda p: p["key"] == "ProteinId")
    return rows.select("accession", "tax_id", F.col("r.id").alias("id"), F.try_element_at(F.transform(protein, lambda p: p["value"]), F.lit(1)).alias("protein_id"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, named): files and whether their name is the hash of their bytes (content store, receipts)."""
    df = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/.]+)(?:\.[^/]*)?$", 1)
    return df.select("path", F.sha2("content", 256).alias("sha256")).withColumn("named", name == F.col("sha256"))


def write_canonical_jsonl(df: DataFrame, path: str, key: str) -> None:
    """JSON lines with columns in order of their names and rows in order of key: equal rows, equal bytes.

    Rows are range-partitioned, so files follow one another in order and none is written alone."""
    ordered = df.select(*sorted(df.columns)).orderBy(key)
    ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_shards(df: DataFrame, path: str, rows: int) -> None:
    """Parquet files of `rows` rows at most."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def frozen_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with repeats counted: empty if content is identical."""
    mark = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return mark(expected, actual, "expected").unionByName(mark(actual, expected, "actual"))
