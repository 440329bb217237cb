"""Instants, lineages, receipts and pivots in literal cases."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import reports


def test_instants(spark):
    cases = [("1970-01-01T00:00:01Z", 1_000_000, None), ("1970-01-01 02:00:00.5+02:00", 500_000, None), ("1970-01-01T00:00:00-00:30", 1_800_000_000, None), ("1970-01-01T00:00:00", None, "no_zone")]
    cases += [(t, None, "invalid") for t in (None, "", "soon", "1970-02-30T00:00:00Z", "1970-01-01T25:00:00Z", "1970-01-01", "1970-01-01T00:00:00 UTC")]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "k int, t string")
    got = {r.k: (r.x.us, r.x.problem) for r in df.select("k", reports.instant(F.col("t")).alias("x")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases]


def test_lineage_and_receipts(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "key int, lineage_of string")
    one, two = spark.createDataFrame([(1, "x"), (1, "w"), (2, None)], "key int, lineage string"), spark.createDataFrame([(1, "y"), (2, "z")], "key int, lineage string")
    got = {r.lineage_of: (r.lineage, r.source) for r in reports.resolve_lineage(keys, [("one", one), ("two", two)], "none").collect()}
    assert got == {"a": ("w", "one"), "b": ("z", "two"), "c": ("none", "fallback"), "d": ("none", "fallback")}
    good = spark.createDataFrame([("f", "1"), ("g", "2")], "name string, digest string")
    assert reports.require_receipts(good, good, "name", "digest").count() == 2
    for other, state in (([("f", "9"), ("g", "2")], "drift"), ([("f", "1")], "unlisted"), ([("f", "1"), ("g", "2"), ("h", "3")], "missing")):
        with pytest.raises(ValueError, match=state):
            reports.require_receipts(spark.createDataFrame(other, "name string, digest string"), good, "name", "digest")


def test_pivots(spark):
    rows = [("a", 2, "l", 0, 1.0, [True, False], True, True), ("a", 2, "l", 0, None, [True, True], False, False), ("b", 1, "m", 3, 2.0, [False], None, True)]
    df = spark.createDataFrame(rows, "arm string, gap int, left string, right int, bits double, matches array<boolean>, rerank_exact boolean, recalled boolean")
    got = {(r.pivot, r.arm, r.x, r.y): (r.value, r.n) for r in reports.report_pivots(df).collect()}
    assert got == {
        ("bits_per_base", "a", "2", None): (1.0, 1), ("bits_per_base", "b", "1", None): (2.0, 1), ("accuracy", "a", "2", None): (0.75, 2), ("accuracy", "b", "1", None): (0.0, 1), ("left_context", None, "l", "2"): (0.75, 2),
        ("left_context", None, "m", "1"): (0.0, 1), ("rerank", None, "2", "0"): (0.5, 2), ("rerank", None, "1", "3"): (0.0, 1), ("recall", None, "2", None): (0.5, 2), ("error_by_offset", "a", "0", None): (0.0, 2),
        ("error_by_offset", "a", "1", None): (0.5, 2), ("error_by_offset", "b", "0", None): (1.0, 1),
    }
    assert reports.report_pivots(df.limit(0)).count() == 0
