"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

An item with n distinct shingles of five words is in a document if at least 0.8 n of them are.
Then all but floor(0.2 n) of the item's shingles are found there, so one at least of the
floor(0.2 n) + 1 with the smallest hashes (its MinHash sketch) is: a search for sketch hashes
alone misses nothing, however long the document. Items are partitioned by size (powers of
two). Each partition has a cut, the largest hash in its sketches, and a least number of shingles
that a document must have; a document drops every shingle above the largest cut of the
partitions it can hold before anything is exploded or joined. Whoever hits a sketch is a
candidate, and only candidates' shingles are then compared as strings and counted.

An item of fewer than five words has one shingle, the whole sequence of its words, and is in a document
where those words follow one another; documents make such shorter runs only of the lengths that items have.

All of it is DataFrame functions. Defined results: null or blank texts have no word and are in no pair;
rows with one doc_id (or item_id) are one document (or item) with the shingles of all; null ids are in no
pair; repeated shingles count once; very long texts are searched whole; an empty table on either side
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch, unused
from .joins import keep_keys

WHITE = "[\\x20\\x09-\\x0D]+"
WIDTH, THRESHOLD = 5, 0.8


def words_of(text: F.Column) -> F.Column:
    """Lower-cased words between ASCII white space; none for null."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) > 0, F.split(bare, WHITE)).otherwise(F.array().cast("array<string>"))


def shingle_strings(words: str, width: int) -> F.Column:
    """Distinct space-joined runs of `width` words of an array column."""
    at = F.sequence(F.lit(1), F.size(words) - (width - 1))
    joined = F.transform(at, lambda i: F.array_join(F.slice(F.col(words), i, width), " "))
    return F.when(F.size(words) >= width, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))


def _hash(words: list[F.Column]) -> F.Column:
    """A shingle's hash is one of its words' hashes."""
    return F.xxhash64(*words)


def _hashes(words: str, width: int) -> F.Column:
    """Hashes of the runs of `width` words, from an array of the words' hashes, with repeats."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    one = F.transform(at, lambda i: _hash([F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, one).otherwise(F.array().cast("array<long>"))


def find_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of each item that a document contains."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    known = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text_col).alias("text"))
    short = F.when(F.size("__w") > 0, F.array(F.array_join("__w", " "))).otherwise(F.array().cast("array<string>"))
    every = F.when(F.size("__w") >= width, shingle_strings("__w", width)).otherwise(short)
    known = known.withColumn("__w", words_of(F.col("text"))).select("item_id", F.explode(every).alias("shingle")).distinct()
    known = scratch.write(known.withColumn("width", F.size(F.split("shingle", " "))), "items")
    need = F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9).cast("long")
    sizes = known.groupBy("item_id").agg(F.count("*").alias("n_shingles")).withColumn("need", need)
    sizes = scratch.write(sizes, "sizes")

    words = F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w))
    made = F.coalesce(*[F.when(F.col("width") == n, _hash([F.get("words", F.lit(k)) for k in range(n)])) for n in range(1, width + 1)])
    hashed = known.withColumn("words", words).select("item_id", "width", made.alias("hash"))
    sketch = (
        hashed.groupBy("item_id")
        .agg(F.sort_array(F.collect_list(F.struct("hash", "width"))).alias("all"))
        .join(sizes, "item_id")
        .select("item_id", "need", F.floor(F.log2("n_shingles")).alias("part"), F.slice("all", 1, F.col("n_shingles") - F.col("need") + 1).alias("low"))
        .select("item_id", "need", "part", F.inline("low"))
    )
    sketch = scratch.write(sketch, "sketch")
    # at most one row for each width and power of two
    parts = sketch.groupBy("width", "part").agg(F.min("need").alias("need"), F.max("hash").alias("cut")).collect()
    widths = sorted({p["width"] for p in parts})

    mine = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    low = mine.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("__w"))
    low = low.select("doc_id", *[_hashes("__w", n).alias(f"h{n}") for n in widths])
    lowest, kept = F.lit(-(2**63)).cast("long"), []
    for n in widths:
        # an item may mix widths (rows with one id), so only items of full shingles ask for a number of them
        sure = n == width == widths[0]
        cuts = [F.when(F.size(f"h{n}") >= (p["need"] if sure else 1), F.lit(p["cut"]).cast("long")) for p in parts if p["width"] == n]
        low = low.withColumn(f"cut{n}", F.greatest(lowest, lowest, *cuts))
        kept.append(F.filter(f"h{n}", lambda h: h <= F.col(f"cut{n}")))  # noqa: B023  called at once
    low = low.select("doc_id", F.explode(F.concat(F.array().cast("array<long>"), *kept)).alias("hash"))
    hits = scratch.write(low.join(sketch.select("hash", "item_id"), "hash").select("doc_id", "item_id").distinct(), "candidates")

    held = keep_keys(mine, hits.select("doc_id").distinct(), "doc_id")
    runs = F.concat(F.array().cast("array<string>"), *[shingle_strings("__w", n) for n in widths])
    held = held.select("doc_id", words_of(F.col("text")).alias("__w")).select("doc_id", F.explode(runs).alias("shingle"))
    shared = held.join(known.drop("width"), "shingle").join(hits, ["doc_id", "item_id"], "left_semi").distinct()
    counts = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    found = counts.join(sizes, "item_id").where("n_shared >= need")
    return found.select(
        F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that contain an item. Texts decide, whatever their ids: a null or repeated id hides nothing."""
    keyed = docs.select(F.md5(F.col(text_col).cast("binary")).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_items(keyed, items, width=width, threshold=threshold).select("doc_id").distinct()
    found = Scratch(docs.sparkSession, "decontaminate").write(found, "contaminated")
    key = unused(docs, "__key")
    marked = docs.withColumn(key, F.md5(F.col(text_col).cast("binary")))
    return keep_keys(marked, found.withColumnRenamed("doc_id", key), key, "left_anti").select(*docs.columns)


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), v AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), k AS (
  SELECT DISTINCT least(len(w), 5) AS k FROM v WHERE len(w) > 0
), d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i+k-1], ' '))) AS shingle FROM w, k
), b AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - least(len(w), 5) + 2, 1)), lambda i: array_to_string(w[i:i+least(len(w), 5)-1], ' '))) AS shingle
  FROM v WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM d JOIN b USING (shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= ceil(0.8 * n_shingles - 1e-9)
"""
