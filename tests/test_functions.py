"""Literal expectations of the column functions, gates and scores."""

import hashlib

import pytest
from pyspark.sql import functions as F

from seqloom.functions import codes
from seqloom.functions import sequence as S
from seqloom.operators import gates, profiles, similarity
from seqloom.operators.dedup import merge_provenance
from seqloom.operators.joins import holdout_split
from seqloom.operators.sampling import round_robin
from seqloom.operators.scalars import reconstruction


def one(spark, column, **values):
    df = spark.range(1, numPartitions=1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("__x"))
    return df.select(column.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("rna", "table", "protein"),
    [("UGAAGAAGGAUA", 1, "*RRI"), ("UGAAGAAGGAUA", 2, "W**M"), ("GUG", 2, "V"), ("CUG", 3, "T"), ("CUG", 99, None), ("UAA", 6, "Q")],
)
def test_translate(spark, rna, table, protein):
    assert one(spark, S.translate(F.col("r"), F.col("t")), r=rna, t=table) == protein


@pytest.mark.parametrize(
    ("rna", "table", "protein"), [("AUGGCUUAA", 1, "MA"), ("AUGAUAUGAAGA", 2, "MMW"), ("AUGUAAGCUUAA", 1, None), ("CCCGCUUAA", 1, None), ("AUGGCU", 1, None)]
)
def test_translate_cds(spark, rna, table, protein):
    assert one(spark, S.translate_cds(F.col("r"), F.col("t")), r=rna, t=table) == protein


@pytest.mark.parametrize(("codon", "kind"), [("AUG", "canonical"), ("GUG", "near_cognate"), ("CCC", "invalid"), ("atg", "canonical")])
def test_initiation(spark, codon, kind):
    assert one(spark, S.initiation_type(F.col("c"), 1), c=codon) == kind


def test_code_tables(spark):
    assert "AGA" in codes.stops(2) and "UGA" not in codes.stops(2)
    assert codes.genetic_codes(spark).count() == 33 * 64
    assert codes.code_map(7) == codes.code_map(1) and codes.starts(32) == codes.starts(1)
    assert len(codes.STANDARD) == 64


@pytest.mark.parametrize(("x", "y"), [("AUGC", "GCAU"), ("ATGC", "GCAT"), ("augN", "Ncau"), ("AATT", "AATT")])
def test_reverse_complement(spark, x, y):
    assert one(spark, S.reverse_complement(F.col("x")), x=x) == y


def test_names_and_terms(spark):
    assert one(spark, S.normalize_name(F.col("x")), x="MT-ATP8 (b)") == "mtatp8b"
    assert one(spark, S.split_terms(F.col("x")), x=" a; b ,,c;") == ["a", "b", "c"]
    assert one(spark, S.stable_accession(F.col("x")), x=" p1.2 ") == "P1"


def test_hamming(spark):
    assert one(spark, S.hamming(F.col("a"), F.col("b")), a="AUGAUCUAA", b="AUGAUUUAA") == 1
    assert one(spark, S.hamming(F.col("a"), F.col("b")), a="AUG", b="AUGA") is None


def test_reconstruction(spark):
    df = spark.createDataFrame([(2, ["AAU", "GAA", "UGA"], ["AAC", "GAA", "AGA"])], "t int, truth array<string>, predicted array<string>")
    r = reconstruction(df, "truth", "predicted", "t").first()
    assert (r.exact_span, r.codons_correct, r.aas_correct, r.synonymous_errors, r.premature_stops, r.first_error) == (False, 1, 2, 1, 1, 1)


def test_diagnostics_accumulate_and_gates_stop_at_the_first(spark):
    df = gates.with_proteins(spark.createDataFrame([("AUGUAAAGCUAC", 1)], "rna string, translation_table int"))
    r = df.select(gates.all_reasons(gates.cds_rules(1)).alias("all"), gates.first_reason(gates.cds_rules(1)).alias("first")).first()
    assert r.all == ["missing_stop", "internal_stop", "not_microprotein"] and r.first == "missing_stop"


@pytest.mark.parametrize(
    ("cov", "periodicity", "peak", "covered"),
    [([10, 0, 0, 15, 0, 0, 20, 0, 0], 1.0, 5.0, 0.333333), ([1, 1, 1], 0.333333, 1.0, 1.0), ([100] * 9 + [10] * 90, 0.333333, 10.0, 1.0), ([0, 0], 0.33, 0.0, 0.0)],
)
def test_coverage_scores(spark, cov, periodicity, peak, covered):
    df = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(cov)], "u int, pos long, x double")
    r = profiles.coverage_scores(df, "u").first()
    assert r.periodicity == periodicity and r.covered == covered
    assert r.peak == pytest.approx(peak if len(cov) > 9 else sum(cov) / len(cov))


@pytest.mark.parametrize(("args", "tier"), [((True, 0.0, 0.0, 0.0, False), 1), ((False, 0.5, 0.0, 0.0, False), 2), ((False, 0.0, 0.0, 0.0, True), 3), ((False, 0.0, 0.0, 0.0, False), 4)])
def test_evidence_tier(spark, args, tier):
    assert one(spark, gates.evidence_tier(*map(F.lit, args))) == tier


def test_entropy_and_rscu(spark):
    counts = spark.createDataFrame([("f", 0, "AAA", 5), ("f", 0, "AAC", 5), ("f", 1, "CCC", 10)], "family string, pos int, codon string, n long")
    found = {r.pos: (r.entropy, r.alleles) for r in profiles.positional_entropy(counts, "family").collect()}
    assert found == {0: (1.0, 2), 1: (0.0, 1)}
    usage = profiles.rscu(spark.createDataFrame([("f", "AUGGCCGCCGCUUAA")], "family string, rna string"), "family")
    got = {r.codon: r.rscu for r in usage.collect()}
    assert got["GCC"] == pytest.approx(8 / 3, abs=1e-6) and got["AAA"] == 1.0 and len(got) == 61


def test_panel_is_even_and_independent_of_order(spark):
    rows = [("f", f"t{k % 8}", f"{k:064d}") for k in range(160)]
    df = spark.createDataFrame(rows, "family string, taxon string, sequence_sha256 string")
    rank = S.json_rank("sequence", 17, F.col("sequence_sha256"))
    a = round_robin(df, ["family", "taxon"], rank, 16, 96).collect()
    b = round_robin(df.repartition(3).orderBy(F.desc("sequence_sha256")), ["family", "taxon"], rank, 16, 96).collect()
    assert a == b and len(a) == 96 and {t: sum(r.taxon == t for r in a) for t in {r.taxon for r in a}} == {f"t{k}": 12 for k in range(8)}


def test_holdout_split_reasons(spark):
    schema = "doc_id long, sequence_sha256 string, family string, taxon string, accession string, parent_accession string"
    train = spark.createDataFrame([(1, "s1", "f", "t", "A1.1", "P1.1")], schema)
    hold = spark.createDataFrame([(2, "s1", "f", "t", "A2.1", "P2.1"), (3, "s3", "f", "t", "a1.7", "P3.1"), (4, "s4", "f", "t", "A4.1", "P1.3"), (5, "s5", "f", "t", "A5.1", "P5.1")], schema)
    found = {r.doc_id: r.reason for r in holdout_split(hold, train).collect()}
    assert found == {2: "training_rna_duplicate", 3: "training_source_accession_overlap", 4: "training_source_accession_overlap", 5: None}


def test_provenance_conflicts_and_priority(spark):
    rows = [("s", "b", "f", 1), ("s", "a", "f", 1), ("s", "a", "f", 1), ("x", "a", "f", 1), ("x", "a", "g", 1)]
    df = spark.createDataFrame(rows, "sequence_sha256 string, taxon string, family string, translation_table int")
    found = {r.sequence_sha256: (r.n_records, r.primary_taxon, r.taxa, r.conflict) for r in merge_provenance(df, ["b"]).collect()}
    assert found == {"s": (3, "b", "b,a", False), "x": (2, "a", "a", True)}


def test_identity_gate_classes(spark):
    from seqloom.operators import alignment

    refs = spark.createDataFrame([("k", "MPSV"), ("k", "MPSVQQ")], "key string, reference string")
    seqs = ["MPSV", "MQSV", "MMPSV", "MPS", "MPSVQQ", "WWWW"]
    df = spark.createDataFrame([("k", s) for s in seqs], "key string, seq string")
    rows = alignment.identity_gate(df, refs, "key", "seq", "reference", 0.7, alignment.ENDS_FREE).collect()
    found = {r.seq: (r.variant, r.identity, r.accepted) for r in rows}
    assert found["MPSV"] == ("EXACT_MATCH", 1.0, True) and found["MPSVQQ"] == ("EXACT_MATCH", 1.0, True)
    assert found["MQSV"] == ("SUBSTITUTION_ONLY", 0.75, True)
    assert found["MMPSV"] == ("N_TERMINAL_EXTENSION", 1.0, True)
    assert found["MPS"] == ("C_TERMINAL_TRUNCATION", 0.75, True)
    assert not found["WWWW"][2]


def test_sequence_identity(spark):
    from seqloom.operators import alignment

    df = spark.createDataFrame([("AUGA", "AUGA"), ("AUGA", "AUCA"), ("AUGAA", "AUAA"), (None, "A")], "a string, b string")
    assert [r.i for r in alignment.sequence_identity(df, "a", "b", "i").collect()] == [1.0, 0.75, 0.8, None]


def records(spark, seqs):
    rows = [(k, s, f"{s}", f, t) for k, (s, f, t) in enumerate(seqs)]
    return spark.createDataFrame(rows, "doc_id long, rna string, sequence_sha256 string, family string, taxon string")


def test_single_linkage_chains(spark):
    a = "A" * 303
    b, c = "C" * 3 + a[3:], "C" * 3 + "A" * 297 + "G" * 3
    found = similarity.clusters(records(spark, [(a, "f", "t"), (b, "f", "t"), (c, "f", "t")]), 0.99)
    assert found.select("cluster").distinct().count() == 1
    apart = similarity.clusters(records(spark, [(a, "f", "t"), (b, "g", "t"), (c, "f", "u"), (a + "AAA", "f", "t")]), 0.9)
    assert apart.select("family", "taxon", "cluster").distinct().count() == 4


def test_thresholds(spark):
    base = "A" * 93
    seqs = [(base, "f", "t"), ("C" + base[1:], "f", "t"), ("G" * 6 + base[6:], "f", "t")]
    n = [similarity.clusters(records(spark, seqs), t).select("cluster").distinct().count() for t in (0.99, 0.95, 0.9)]
    assert n == [3, 2, 1]


def test_pairs_match_brute_force(spark):
    import random

    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGU") for _ in range(60)) for _ in range(12)]
    for s in list(seqs):
        for _ in range(3):
            t = list(s)
            for k in rng.sample(range(60), rng.randint(1, 9)):
                t[k] = rng.choice("ACGU")
            seqs.append("".join(t))
    seqs = sorted(set(seqs))
    found = {(r.a, r.b, r.differences) for r in similarity.similar_pairs(records(spark, [(s, "f", "t") for s in seqs]), 0.9).collect()}
    dist = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert found == {(a, b, dist(a, b)) for a in seqs for b in seqs if a < b and dist(a, b) <= 6} and found


def test_extended_window_fills_flanks_and_marks_every_base(spark):
    from seqloom.operators.scalars import downsample, extended_window

    rows = spark.createDataFrame([("CCAUGGCUUAAGG", 2, 9), ("AUG", 0, 3), (None, 0, 3)], "rna string, tis int, size int")
    w = rows.select(extended_window(F.col("rna"), F.col("tis"), F.col("size"), flank=9).alias("w")).select("w.*", downsample(F.col("w.segments")).alias("track")).collect()
    assert tuple(w[0]) == ("AAAACCAUGG", "AAAAAAACC" + "AUGGCUUAA" + "GGAAAAAAA", "000111111" + "111122222" + "333333333", "011112333")
    assert tuple(w[1]) == ("AAAAAAAUGA", "A" * 9 + "AUG" + "A" * 9, "000111111" + "111" + "333333333", "0111333")
    assert w[2].extended is None


def test_matched_views_take_the_least_ranks_of_each_view(spark):
    from seqloom.operators.sampling import matched_views

    rows = spark.createDataFrame([("big", f"k{i}") for i in range(300)] * 2 + [("small", f"k{i}") for i in range(7)], "view string, key string")
    found = matched_views(rows, "view", "key").collect()
    ranked = {v: sorted({k for w, k in map(tuple, rows.collect()) if w == v}, key=lambda k: hashlib.sha256(f"17:{v}:{k}".encode()).hexdigest())[:7] for v in ("big", "small")}
    assert sorted(map(tuple, found)) == sorted((v, k, n + 1) for v, ks in ranked.items() for n, k in enumerate(ks))


def test_unknown_genetic_codes_give_null(spark):
    rows = spark.createDataFrame([("AUGUGA", 1), ("AUGUGA", 2), ("AUGUGA", 0), ("AUGUGA", 34), ("AUGUGA", None), (None, 1)], "rna string, t int")
    t = F.col("t")
    got = [tuple(r) for r in rows.select(S.translate(F.col("rna"), t), S.amino_acid(F.lit("UGA"), t), S.is_stop(F.lit("UGA"), t), S.translate_cds(F.col("rna"), t)).collect()]
    assert got == [("M*", "*", True, "M"), ("MW", "W", False, None), (None,) * 4, (None,) * 4, (None,) * 4, (None, "*", True, None)]
