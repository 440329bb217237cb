"""Locations against a recursive reader; gates on records with nulls."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from seqloom.functions import locations
from seqloom.operators import feature_gates

PAIRS = dict(zip("ACGTacgtN", "TGCAtgcaN", strict=True))


def made(r: random.Random, depth: int) -> tuple[str, list[tuple]]:
    """A location and its parts: (first, last, strand, exact, remote)."""
    kind = r.choice(["span", "span", "one"] if depth == 0 else ["span", "join", "complement", "order", "join"])
    if kind in ("span", "one"):
        a = r.randint(1, 50)
        b = a if kind == "one" else r.randint(a, 60)
        left, right, other = r.choice(["", "", "", "<"]), r.choice(["", "", "", ">"]), r.choice(["", "", "X1.2:"])
        text = f"{a}" if kind == "one" else f"{left}{a}..{right}{b}"
        return other + text, [(a, b, 1, kind == "one" or not left + right, bool(other))]
    inner = [made(r, depth - 1) for _ in range(1 if kind == "complement" else r.randint(1, 3))]
    parts = [p for _, ps in inner for p in ps]
    if kind == "complement":
        parts = [(a, b, -s, e, o) for a, b, s, e, o in reversed(parts)]
    return f"{kind}({','.join(t for t, _ in inner)})", parts


def test_nested_locations(spark):
    r = random.Random(4)
    known = [made(r, k % 4) for k in range(200)]
    bad = ["join(1..5", "1..5)", "", "complement()", "x..y", "join(1..5,oops)", ")1..2(", None]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(known)] + [(1000 + k, t) for k, t in enumerate(bad)], "k int, t string")
    got = {x.k: x.p for x in df.select("k", locations.parts(F.col("t")).alias("p")).collect()}
    for k, (text, parts) in enumerate(known):
        assert [tuple(p) for p in got[k]] == parts, text
    assert all(got[1000 + k] is None for k in range(len(bad)))


def test_extracted_bases(spark):
    r = random.Random(8)
    dna = "".join(r.choice("ACGT") for _ in range(60))
    known = [made(r, k % 4) for k in range(60)]
    df = spark.createDataFrame([(k, t, dna) for k, (t, _) in enumerate(known)], "k int, t string, dna string")
    got = {x.k: x.d for x in df.select("k", locations.extract(F.col("dna"), locations.parts(F.col("t"))).alias("d")).collect()}
    for k, (text, parts) in enumerate(known):
        pieces = [dna[a - 1 : b] if s > 0 else "".join(PAIRS[c] for c in reversed(dna[a - 1 : b])) for a, b, s, _, _ in parts]
        assert got[k] == "".join(pieces), text


def test_gates_with_nulls_and_empty_tables(spark):
    """Every column null in turn: a reason, never an error; a feature list that is null has no feature."""
    schema = "id string, listed_id string, protein_id string, n_cds int, taxa array<string>, qualifiers array<string>, codon_start string, location string, dna string, base_count int, sequence_md5 string, transl_table string, translation string, expected_taxon string, expected_table int, isoforms array<string>"
    dna = "ATGGCTTGGTGCCATTGGTAA"
    good = ["A.1", "A.1", "A.1", 1, ["t"], [], None, "1..21", dna, 21, None, "1", "MAWCHW", "t", 1, ["MAWCHW", None, ""]]
    rows = [good] + [[None if j == k else v for j, v in enumerate(good)] for k in range(len(good))] + [[*good[:10], "0", *good[11:]], [*good[:8], "", *good[9:]]]
    df = spark.createDataFrame([tuple(x) for x in rows], schema)
    first = [x.reason for x in feature_gates.secondary_gate(df).collect()]
    want = [None, "accession_mismatch", "accession_mismatch", "accession_mismatch", "not_one_cds", "wrong_taxon", None, None, "partial_location", "ambiguous_bases", "length_metadata_mismatch", None]
    want += ["unexpected_genetic_code", "translation_mismatch", "wrong_taxon", "unexpected_genetic_code", "no_reference_sequence", "sequence_hash_mismatch", "ambiguous_bases"]
    assert first == want
    complete = feature_gates.complete_cds_gate(df).collect()
    assert sorted(x.reason or "" for x in complete) == sorted(x or "" for x in want) and {x.variant for x in complete if x.reason is None} == {"EXACT_MATCH"}
    assert feature_gates.complete_cds_gate(df.limit(0)).count() == 0
    feature = "array<struct<type:string,gene:string,product:string,protein_id:string,location:string,transl_table:string,translation:string,qualifiers:array<string>,codon_start:string>>"
    parents = "id string, listed_id string, tax_id string, reference_taxon string, sequence string, base_count int, sequence_md5 string, taxa array<string>, expected_table int, isoforms array<string>"
    f = [("CDS", None, "Protein X", "Q.1", "complement(3..23)", "1", "MAWCHW", None, None)]
    back = "CC" + "".join(PAIRS[c] for c in reversed(dna)) + "G"
    line = ("P.1", "P.1", "t", "t", back, 24, None, ["t"], 1, ["MAWCHW"])
    df = spark.createDataFrame([(*line, f), (*line, None), (*line, f * 2), (*line[:4], "", *line[5:], f)], f"{parents}, features {feature}")
    got = feature_gates.parent_gate(df, ["protein-x"]).collect()
    assert sorted((x.reason or "", x.dna or "") for x in got) == [("", dna), ("missing_annotated_cds", ""), ("multiple_annotated_cds", ""), ("undefined_parent_sequence", "")]
