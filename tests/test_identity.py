"""Identity checks, strict verification and dependent views: what raises, nulls, empty tables."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import identity, sampling

SCHEMA = "id string, rna string, family string, gene string, tax_id int, translation_table int, taxa array<int>, accessions array<string>"
GOOD = ("r1", "AUGGCUUAA", "f", "G", 5, 1, [5], ["A1.2"])


def judged(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sequence_sha256", F.sha2("rna", 256)).withColumn("known", F.lit(1))
    return identity.record_identity(df, {"m": 2}, 1, {"GENE": "f"})


def test_each_check_and_nulls(spark):
    cases = [
        (GOOD, None), ((*GOOD[:1], None, *GOOD[2:]), "incomplete_codons"), ((*GOOD[:2], None, "GENE", *GOOD[4:]), None), ((*GOOD[:2], " ", None, *GOOD[4:]), "empty_family"),
        ((*GOOD[:4], None, *GOOD[5:]), "invalid_taxon"), ((*GOOD[:5], None, *GOOD[6:]), "unsupported_code"), ((*GOOD[:2], "m", *GOOD[3:]), "family_code_mismatch"),
        ((*GOOD[:6], None, None), None), ((*GOOD[:6], [5, None], None), "invalid_taxa"), ((*GOOD[:6], [], None), "taxon_not_in_taxa"), (("x", "AUGUAGGCUUAA", *GOOD[2:]), "internal_stop"),
        (("x", "GCUGCUUAA", *GOOD[2:]), "incomplete_cds"), (("x", "AUG" + "GCU" * 100 + "UAA", *GOOD[2:]), "not_microprotein"), (("x", "AUGGCU" + "UA", *GOOD[2:]), "incomplete_codons"),
    ]
    got = [r.reason for r in judged(spark, [c for c, _ in cases]).collect()]
    assert got == [w for _, w in cases]


def test_verification_raises_on_the_first_failure(spark):
    train = judged(spark, [("t1", "AUGGGGUAA", "f", "G", 5, 1, None, ["T1.1", None]), ("t2", "AUGCCCUAA", "f", "G", 9, 1, None, None)])

    def reasons(*rows):
        df = identity.verify_holdout(judged(spark, rows), train, [5, 6], ["f"])
        return {r.id: r.reason for r in df.collect()}, df

    a = ("a", "AUGGCUUAA", "f", "G", 5, 1, None, ["A.1"])
    found, df = reasons(a, ("b", "AUGGCGUAA", "f", "G", 6, 1, [6, 5], ["B"]))
    assert found == {"a": None, "b": None} and identity.require_valid(df, "cohort").columns == ["id"]
    rows = [a, ("b", "AUGGCUUAA", "f", "G", 5, 1, None, ["B"]), ("c", "AUGACAUAA", "f", "G", 5, 1, [5, 9], ["C"]), ("d", "AUGGGGUAA", "f", "G", 5, 1, None, ["D"])]
    rows += [("e", "AUGACCUAA", "g", "G", 5, 1, None, ["E"]), ("f", "AUGACGUAA", "f", "G", 5, 1, None, [None, ""]), ("g", "AUGACUUAA", "f", "G", 5, 1, None, ["t1.9"])]
    found, df = reasons(*rows)
    assert found == {"a": "duplicate_rna", "b": "duplicate_rna", "c": "taxon_not_allowed", "d": "training_rna", "e": "family_not_allowed", "f": "no_provenance", "g": "source_overlap"}
    with pytest.raises(ValueError, match=r"cohort: duplicate_rna \(2 records\)"):
        identity.require_valid(df, "cohort")
    with pytest.raises(ValueError, match="no records"):
        identity.require_valid(df.limit(0), "cohort")


def views(spark, rows):
    df = spark.createDataFrame([(f, t, f"{f}{t}{k}") for f, t, n in rows for k in range(n)], "family string, taxon string, sequence_sha256 string")
    return sampling.dependent_views(df, "focus", ["n1", "n2"], ["x1", "x2"], "lead")


def test_dependent_views(spark):
    rows = [("lead", "focus", 9), ("a", "focus", 5), ("b", "focus", 1), ("lead", "n1", 2), ("lead", "n2", 1), ("a", "n2", 9), ("lead", "x1", 1), ("a", "x2", 5)]
    got = views(spark, rows).collect()
    of = lambda v, f: [r for r in got if r.view == v and r.family == f]
    # nine of the lead: half go to the others, three to a (its share of two passes and one more) and one to b
    quota = {"lead": 5, "a": 3, "b": 1}
    for view in ("focus", "near", "far"):
        assert {f: len(of(view, f)) for f in quota} == quota
        assert sorted(r.place for r in got if r.view == view) == list(range(9))
    # common 2; near fills all three places of the lead; far replaces half of them, as far as there are any
    assert sorted(r.taxon for r in of("near", "lead")) == ["focus", "focus", "n1", "n1", "n2"] and sorted(r.taxon for r in of("near", "b")) == ["focus"]
    assert sorted(r.taxon for r in of("far", "lead")) == ["focus", "focus", "n1", "n2", "x1"] and sorted(r.taxon for r in of("far", "a")) == ["focus", "n2", "x2"]
    assert len(got) == 9 * 3 + 9 + 15 + (15 + 12) + (15 + 12 + 6)


@pytest.mark.parametrize(
    "rows,message",
    [
        ([("lead", "focus", 3), ("a", "focus", 1), ("a", "z", 1)], "unexpected taxon"), ([("lead", "focus", 2), ("a", "focus", 1)], "fewer than three"), ([("lead", "focus", 5)], "no related family"),
        ([("lead", "focus", 6), ("a", "focus", 3), ("lead", "n1", 5), ("lead", "x1", 5)], "near view has fewer than two"), ([("lead", "focus", 6), ("a", "focus", 3), ("lead", "n1", 5), ("a", "n2", 5)], "no far taxon"),
    ],
)
def test_invariants_raise(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        views(spark, rows)
    doubled = spark.createDataFrame([("lead", "focus", "s")] * 2, "family string, taxon string, sequence_sha256 string")
    with pytest.raises(ValueError, match="twice"):
        sampling.dependent_views(doubled, "focus", ["n1", "n2"], ["x1"], "lead")
