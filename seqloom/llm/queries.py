"""The thin queries over the operators of this subpackage, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_in_middle, merkle, mixing, pii, quality, simhash, substring_dedup, topk, toxicity, url_filter, warc
from ..plans.storage import Scratch
from ..registry import whole
from .sentencepiece_bpe import digests, sentencepiece_encode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """A vocabulary file's place: TOKENIZERS_DIR if set, else the installed package of public tokenizers."""
    if found := os.environ.get("TOKENIZERS_DIR"):
        return f"{found}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sentencepiece_encode(table(spark, sf_dir, "documents"), tokenizer_file()))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    files = scratch.write(warc.archives(warc.with_record_types(table(spark, sf_dir, "pages"), scratch)), "archives")
    read = warc.read_archives(files, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.spans(table(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(spark, "urls").write(url_filter.parsed(table(spark, sf_dir, "pages")), "parsed")
    # the list: hosts under names known to be bad
    return url_filter.judge(rows, url_filter.listed_hosts(rows.select("host").distinct()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    # tampering: one more character is claimed where 7 divides the id's CRC-32
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    claims = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + more}
    return merkle.digests(merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", columns, claims)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: whole(f)
        for f in (
            op1_sentencepiece,
            op2_decontaminate,
            op3_quality,
            op4_topk,
            op5_warc,
            op6_pii,
            op7_substring_dedup,
            op8_url_filter,
            op9_simhash,
            op10_toxicity,
            op11_merkle,
            op12_fill_in_middle,
            op13_mixing,
        )
    }


#: Products of quantised vectors, ties to the smaller id.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.SQL, "op4_topk": TOPK_SQL, "op5_warc": warc.SQL, "op8_url_filter": url_filter.SQL, "op11_merkle": merkle.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_mixing": mixing.SQL}
