"""Corpus pipeline: stages over documents, each written and read again as the next one's input.

All stages: null and blank texts are documents like any other, texts of any length are read whole, repeated rows
are judged alike, null ids are kept, further columns go through all stages but the last whatever their names, and an
empty table gives an empty one. The last stage returns its own columns only. What is particular to a stage stands with it, the rest in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontaminate, near_copies, pii, toxicity
from seqloom.llm.queries import table, tokenizer_file
from seqloom.llm.sentencepiece_bpe import sentencepiece_encode
from seqloom.plans.storage import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the model is trained on the labelled ones among docs. A chance at the threshold is toxic;
    without labels of both classes nothing goes."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more) stays, that with the
    smallest id (of several rows with it, any one); null ids come last, and all blank texts are one group."""
    return near_copies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; one without words contains none, and without items nothing goes."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced and no document goes; n_chars follows a text that changes, and stays with others."""
    return pii.sanitise(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document; a null text has no ids and an empty decoded one."""
    return sentencepiece_encode(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pii", sanitise),
    ("sentencepiece", encode),
]

#: Training, fingerprints and tokenization are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own scratch tables go when its output is written, and that when it was read."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, made = written(spark, f"pipeline-{name}", lambda: stage(spark, docs, sf_dir))  # noqa: B023  called at once
        if last:
            last.drop()
        last = made
    return docs
