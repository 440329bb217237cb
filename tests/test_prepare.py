"""Preparation in all modes: what raises, and what a reader is told."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import prepare
from seqloom.plans.storage import Scratch

SCHEMA = "sequence_sha256 string, rna string"


def digest(df):
    return prepare.set_digest(df, ["sequence_sha256", "rna"]).first().digest


def test_round_trip_and_guards(spark):
    df = spark.createDataFrame([("a", "AUGUAA"), ("b", "AUGGCUUAA")], SCHEMA)
    folder, want = Scratch(spark, "prep").root, digest(df)
    assert want == digest(df.repartition(3).orderBy(F.desc("rna"))) and want != digest(df.limit(1)) != digest(df.union(df))
    rows = {r.mode: (r.sequences, r.tokens, r.longest) for r in prepare.prepare(df, folder, want).collect()}
    assert rows == {"base": (2, 15, 9), "codon": (2, 5, 3)}
    got = {r.sequence_sha256: r.tokens for r in prepare.open_prepared(spark, folder, "codon", want).collect()}
    assert got == {"a": [4 + 3, 16], "b": [7, 3 * 16 + 2 * 4 + 1, 16]}
    assert {r.sequence_sha256: r.tokens for r in prepare.open_prepared(spark, folder, "base", want).collect()}["a"] == [0, 1, 3, 1, 0, 0]
    with pytest.raises(ValueError, match="another cohort"):
        prepare.open_prepared(spark, folder, "base", "other")
    prepare.encoded(df.limit(1)).write.mode("append").partitionBy("mode").parquet(f"{folder}/tokens")
    with pytest.raises(ValueError, match="differ from the manifest"):
        prepare.open_prepared(spark, folder, "base", want)
    with pytest.raises(ValueError, match="cut off"):
        prepare.open_prepared(spark, f"{folder}-none", "base", want)


@pytest.mark.parametrize("rows,message", [([("a", "AUGUAA"), ("a", "AUGUAA")], "twice"), ([], "empty"), ([("a", "AUG")], "too short"), ([("a", "AUGUA")], "whole codons"), ([("a", None)], "whole codons"), ([("a", "AUGNAA")], "whole codons")])
def test_bad_cohorts(spark, rows, message):
    df = spark.createDataFrame(rows, SCHEMA)
    folder = Scratch(spark, "bad").root
    with pytest.raises(ValueError, match=message):
        prepare.prepare(df, folder, digest(df))
    with pytest.raises(ValueError, match="has changed"):
        prepare.prepare(df, folder, "x")
