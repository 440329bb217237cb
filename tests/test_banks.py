"""Stored banks: only new ones are generated, what is stored is guarded; results are judged from what is stored."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import banks
from seqloom.plans.storage import Scratch

CASE = "doc_id long, plan string, model_id string, sequence_sha256 string, start int, gap int, left_context int, prefix string, truth string, suffix string, translation_table int"


def case(k: int, **other) -> tuple:
    row = {"doc_id": k, "plan": "p", "model_id": "m", "sequence_sha256": f"s{k // 2}", "start": 4, "gap": 2, "left_context": 1, "prefix": "AUG", "truth": "GCUGCU", "suffix": "UAA", "translation_table": 1} | other
    return tuple(row.values())


def proposals(seen: list):
    def propose(asked):
        seen.append(sorted(r.sequence_sha256 for r in asked.collect()))
        assert not {"truth", "suffix"} & set(asked.columns)
        return asked.withColumn("candidates", F.array(F.concat(F.lit("GCU"), F.col("prefix"))))

    return propose


def test_reuse_and_guards(spark):
    store, seen = banks.BankStore(spark, f"{Scratch(spark, 'store').root}/banks"), []
    frame = lambda ks, **o: spark.createDataFrame([case(k, **o) for k in ks], CASE)
    assert store.banks() is None and store.ensure(frame([]), proposals(seen)).count() == 0
    first = store.ensure(frame(range(4)), proposals(seen)).collect()
    assert seen[-1] == ["s0", "s1"] and all(r.fresh for r in first)
    second = {r.sequence_sha256: r.fresh for r in store.ensure(frame(range(8)), proposals(seen)).collect()}
    assert seen[-1] == ["s2", "s3"] and second == {"s0": False, "s1": False, "s2": True, "s3": True}
    store.ensure(frame(range(8)), proposals(seen))
    assert seen[-1] == [] and store.banks().count() == 4
    with pytest.raises(ValueError, match="different prefixes"):
        store.ensure(frame([0]).union(frame([1], prefix="CCC")), proposals(seen))
    for column in ("candidates", "start"):
        bad = store.banks().withColumn("candidates", F.array(F.lit("CCCCCC"))) if column == "candidates" else store.banks().withColumn("start", F.lit(9))
        other = banks.BankStore(spark, f"{Scratch(spark, 'changed').root}/banks")
        bad.write.parquet(other.folder)
        with pytest.raises(ValueError, match="has changed"):
            other.ensure(frame(range(2)), proposals(seen))


def test_results_are_judged_from_what_is_stored(spark):
    rows = [("p", 2, 1, "GCUGCU", "GCUGCC", False, 1, 2), ("p", 2, 1, "GCUGCU", "GCUGCU", True, 2, 2), ("p", 2, 1, "GCUGCU", None, False, 0, 0), ("q", 2, 1, "GCUGCU", "GCUGCU", True, 2, 2)]
    rows += [("p", 2, 1, "GCUGC", "GCUGCU", True, 2, 2), ("p", 2, 1, "GCUGCU", "GCNGCU", False, 1, 1), ("p", 2, 1, "GCUGCU", "GCUGCC", False, 2, 2), ("p", 2, 1, None, "GCUGCC", False, 0, 0), (None, 2, 1, "GCUGCU", "GCUGCU", True, 2, 2)]
    df = spark.createDataFrame(rows, "plan string, gap int, translation_table int, truth string, prediction string, exact boolean, correct_codons int, correct_acids int")
    assert [r.problem for r in banks.revalidate(df, "p").collect()] == [None, None, None, "other_plan", "invalid_sequence", "invalid_sequence", "metrics_disagree", "invalid_sequence", "other_plan"]
    assert banks.require_results(df.limit(3), "p").count() == 3 and banks.require_results(df.limit(0), "p").count() == 0
    with pytest.raises(ValueError, match="stored results"):
        banks.require_results(df, "p")
