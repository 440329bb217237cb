"""Quality categories and record annotation: nulls and each branch."""

import pytest

from seqloom.operators import annotation


def test_categories(spark):
    schema = "k int, protein string, initiation_codon string, initiation_type string, identity double, is_lead boolean, reviewed boolean, impi_class string, uniprot string"
    rows = [
        (1, "MA", "AUG", "canonical", 0.95, None, True, None, None), (2, "MA", "AUG", "canonical", 0.94, None, None, "Verified x", None), (3, "MA", "AUU", "invalid", 0.99, None, None, None, "P1"),
        (4, "MA", "AUG", "canonical", 0.99, True, None, None, "A1"), (5, "MA", "ACG", None, 0.99, None, None, None, "Q1"), (6, None, None, None, None, None, None, None, None), (7, "MA", "AUG", "canonical", 1.0, True, None, None, "O1"),
    ]
    got = {r.k: r for r in annotation.quality_category(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k].tier for k in range(1, 8)] == [1, 2, 1, 3, 3, 2, 1]
    assert got[1].rationale == ["Swiss-Prot/IMPI verified reference", "High reference identity (0.950)", "Canonical initiation codon (AUG)", "Complete verified CDS"]
    assert got[3].rationale[-1] == "Curated gene family candidate" and got[3].tier_name == annotation.TIERS[1] and got[4].rationale[-1] == "Uncharacterized sORF prediction lead"
    assert len(got[5].rationale) == 2 and got[6].rationale == ["Standard annotated genomic CDS feature", "Valid reading frame (0 aa)", "Reference identity (0.000)"]


def test_annotation(spark):
    records = spark.createDataFrame([(1, "AUGUAA", 1, True, None), (2, "AUGGCUUAA", 2, None, True), (3, None, 3, None, True), (4, "AUG", None, None, None)], "id int, rna string, series_id int, has_ms boolean, is_conserved boolean")
    series = spark.createDataFrame([(2, k, 9.0 if k % 3 == 0 else 1.0) for k in range(12)], "series_id int, pos int, x double")
    got = {r.id: r for r in annotation.annotate(records, series).collect()}
    assert {k: got[k].evidence_tier for k in got} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert got[2].periodicity == pytest.approx(36 / 44, abs=1e-6) and got[2].covered == 1.0 and (got[1].periodicity, got[1].peak, got[1].covered) == (0.33, 1.0, 0.0)
    assert (got[3].cai, got[3].tai) == (1.0, 1.0) and annotation.annotate(records.limit(0), series).count() == 0
