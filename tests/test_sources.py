"""Readers, writers and streams over small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from seqloom.sources import files
from seqloom.sources.views import positions
from seqloom.streaming import ledger

EMBL = """ID   AB1; SV 1; linear; genomic DNA; STD; HUM; 12 BP.
AC   AB1;
DE   short coding
DE   sequence
FT   CDS             1..12
FT                   /protein_id="CAA1.1"
FT                   /translation="MA
FT                   K"
SQ   Sequence 12 BP;
     atggctaaat aa                                                            12
//
ID   AB2; SV 1; linear; genomic DNA; STD; HUM; 3 BP.
AC   AB2;
SQ   Sequence 3 BP;
     atg                                                                       3
//
"""
XML = """<?xml version="1.0"?><INSDSet><INSDSeq><INSDSeq_length>24</INSDSeq_length><INSDSeq_organism>Homo</INSDSeq_organism>
<INSDSeq_feature-table><INSDFeature><INSDFeature_key>CDS</INSDFeature_key><INSDFeature_location>13..21</INSDFeature_location>
<INSDFeature_quals><INSDQualifier><INSDQualifier_name>gene</INSDQualifier_name><INSDQualifier_value>ATP8</INSDQualifier_value></INSDQualifier>
<INSDQualifier><INSDQualifier_name>gene</INSDQualifier_name><INSDQualifier_value>MTATP8</INSDQualifier_value></INSDQualifier></INSDFeature_quals></INSDFeature></INSDSeq_feature-table>
<INSDSeq_sequence>acgt</INSDSeq_sequence><INSDSeq_accession-version>X1.1</INSDSeq_accession-version></INSDSeq></INSDSet>"""


def test_embl(spark, tmp_path):
    (tmp_path / "a.embl").write_text(EMBL)
    rows = {r.id: r for r in files.read_embl(spark, str(tmp_path)).collect()}
    assert rows["AB1"].sequence == "ATGGCTAAATAA" and rows["AB1"].translation == "MAK" and rows["AB1"].protein_id == "CAA1.1"
    assert rows["AB1"].description == "short coding sequence" and rows["AB1"].length == 12
    assert rows["AB2"].sequence == "ATG" and rows["AB2"].translation is None and len(rows) == 2


def test_embl_features(spark, tmp_path):
    text = """ID   A1; SV 1; linear; mRNA; STD; HUM; 30 BP.
FT   source          1..30
FT                   /organism="Homo
FT                   sapiens"
FT                   /db_xref="taxon:9606"
FT   CDS             complement(join(2..4,
FT                   10..12))
FT                   /codon_start=1
FT                   /pseudo
FT                   /db_xref="X:1"
FT                   /db_xref="Y:2"
FT                   /translation="MA
FT                   KL"
FT   gene            B2.1:1..3
SQ   Sequence 30 BP;
     acgtacgtac gtacgtacgt acgtacgtac        30
//
ID   A2; SV 1; linear; mRNA; STD; HUM; 4 BP.
SQ   Sequence 4 BP;
     acgt        4
//
"""
    (tmp_path / "f.embl").write_text(text)
    rows = files.read_embl_features(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.id, r.key, r.location, r.bases) for r in rows] == [("A1", "source", "1..30", "ACGTACGTAC" + "GTACGTACGT" + "ACGTACGTAC"), ("A1", "CDS", "complement(join(2..4,10..12))", "ACG" + "ACG"), ("A1", "gene", "B2.1:1..3", None)]
    assert rows[1].qualifiers == {"codon_start": ["1"], "pseudo": [""], "db_xref": ["X:1", "Y:2"], "translation": ["MAKL"]} and rows[0].qualifiers["organism"] == ["Homo sapiens"]
    assert [(p.first, p.last, p.strand) for p in rows[1].parts] == [(10, 12, -1), (2, 4, -1)]


def test_requested_records(spark):
    got, asked = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    records, missing = files.requested_records(got, asked)
    assert records.count() == 2 and [r.id for r in missing.collect()] == ["c"]
    for bad in (got.union(got.limit(1)), got.union(spark.createDataFrame([("z", 1)], "id string, n int"))):
        with pytest.raises(ValueError, match="come twice"):
            files.requested_records(bad, asked)


def test_insdseq(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    r = files.read_insdseq(spark, str(tmp_path)).first()
    assert (r.accession, r.length, r.sequence, r.key, r.location) == ("X1.1", 24, "ACGT", "CDS", "13..21")
    assert r.qualifiers == {"gene": ["ATP8", "MTATP8"]}


def test_tsv_count(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("accession\tgene\nA1\tATP8\nA2\t\n")
    assert files.read_tsv(spark, str(tmp_path / "i.tsv"), ["accession", "gene"], 2).count() == 2
    with pytest.raises(Exception, match="should have 3 rows"):
        files.read_tsv(spark, str(tmp_path / "i.tsv"), ["accession", "gene"], 3).collect()


def test_cross_references(spark, tmp_path):
    entry = {"primaryAccession": "P1", "organism": {"taxonId": 9606}, "uniProtKBCrossReferences": [{"database": "EMBL", "id": "M1", "properties": [{"key": "ProteinId", "value": "AAA1.1"}]}, {"database": "PDB", "id": "1X", "properties": []}]}
    (tmp_path / "e.jsonl").write_text(json.dumps(entry) + "\n\n")
    schema = "primaryAccession string, organism struct<taxonId: int>, uniProtKBCrossReferences array<struct<database: string, id: string, properties: array<struct<key: string, value: string>>>>"
    rows = files.flatten_cross_references(files.read_jsonl(spark, str(tmp_path), schema)).collect()
    assert [tuple(r) for r in rows] == [("P1", 9606, "M1", "AAA1.1")]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.5), (3, "c", 1.5)], "k int, name string, x double")
    files.write_canonical_jsonl(df, f"{tmp_path}/j", "k")
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    assert text.splitlines() == ['{"k":1,"name":"a","x":0.5}', '{"k":2,"name":"b","x":null}', '{"k":3,"name":"c","x":1.5}']
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_canonical_jsonl(df, f"{tmp_path}/j", "k")
    files.write_shards(df.coalesce(1), f"{tmp_path}/p", 2)
    assert len(list((tmp_path / "p").glob("part-*"))) == 2 and spark.read.parquet(f"{tmp_path}/p").count() == 3
    files.write_report(df, f"{tmp_path}/c")
    assert files.frozen_difference(df, spark.read.parquet(f"{tmp_path}/p")).count() == 0
    assert files.frozen_difference(df, df.limit(0)).count() == 3


def test_payload_store(spark, tmp_path):
    data = b"<x/>"
    (tmp_path / f"{hashlib.sha256(data).hexdigest()}.xml").write_bytes(data)
    (tmp_path / "other.xml").write_bytes(data)
    assert sorted(r.named for r in files.read_payloads(spark, str(tmp_path)).collect()) == [False, True]


def test_positions_of_hot_groups(spark):
    rows = [(k % 3 and 1, k) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, k int")
    found = {(r.g, r.k): r.pos for r in positions(df, ["g"], F.floor(F.col("k") / 7), ["k"]).collect()}
    for g in (0, 1):
        mine = sorted(k for h, k in rows if h == g)
        assert [found[g, k] for k in mine] == list(range(len(mine)))
    assert positions(df.limit(0), [], F.col("k"), ["k"]).count() == 0


def test_streams(spark, tmp_path):
    source, schema = tmp_path / "in", "raw_sha256 string, accession string, observation string, ts timestamp, n long"
    source.mkdir()
    row = lambda *x: json.dumps(dict(zip(("raw_sha256", "accession", "observation", "ts", "n"), x, strict=True)))
    (source / "1.json").write_text("\n".join([row("s1", "A1", "o1", "2024-01-01T00:00:00", 1), row("s1", "A2", "o2", "2024-01-01T00:10:00", 2), row("s2", "B", "o3", "2024-01-01T01:00:00", 3)]))

    def run(name):
        q = ledger.first_observations(ledger.observations(spark, str(source), schema)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).count()

    assert run("firsts") == 2
    for more in ([], [row("s1", "A3", "o4", "2024-01-01T02:00:00", 9)]):
        if more:
            (source / "2.json").write_text("\n".join(more))
        ledger.upsert_stream(ledger.observations(spark, str(source), schema), str(tmp_path / "store"), str(tmp_path / "ckpt"), "raw_sha256", ["accession", "observation"], "n", "ts").awaitTermination(120)
    got = {r.raw_sha256: (r.accession, r.observation, r.n) for r in spark.read.parquet(f"{tmp_path}/store/v=1").collect()}
    assert got == {"s1": (["A1", "A2", "A3"], ["o1", "o2", "o4"], 9), "s2": (["B"], ["o3"], 3)}


def test_receipts(spark):
    from seqloom.operators.audits import check_receipts

    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, d string")
    have = spark.createDataFrame([("a", "1"), ("b", "x"), ("e", "5")], "name string, d string")
    found = {r["name"]: r["state"] for r in check_receipts(want, have, "name", "d").collect()}
    assert found == {"a": "ok", "b": "drift", "c": "missing", "e": "unlisted"}


def test_offsets(spark):
    from seqloom.operators.audits import offset_breaks

    rows = [("good", 0, 3), ("good", 3, 2), ("good", 5, 4), ("gap", 0, 3), ("gap", 4, 1), ("late", 1, 5)]
    spans = spark.createDataFrame(rows, "store string, start long, n long")
    found = {r["store"]: tuple(r)[1:] for r in offset_breaks(spans, "store", "start", "n").collect()}
    # in gap one span ends at 3 where none starts; its last end, 5, lies beyond the total
    assert found == {"good": (3, 9, True, 0, 0), "gap": (2, 4, True, 1, 1), "late": (1, 5, False, 0, 1)}


def test_first_error_and_banks(spark):
    from pyspark.sql import functions as F

    from seqloom.operators.audits import candidate_banks, family_macro, first_error, lenient_codons

    pairs = spark.createDataFrame([(["A", "B"], ["A", "B"]), (["A", "B"], ["A", "C"]), (["A"], ["A", "C"]), ([], [])], "t array<string>, p array<string>")
    assert [r[0] for r in pairs.select(first_error(F.col("t"), F.col("p"))).collect()] == [None, 2, None, None]
    texts = spark.createDataFrame([("acgtnnACGa",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(lenient_codons(F.col("t"))).collect()] == [["ACG", "ACG"], [], None]
    cases = spark.createDataFrame([(1, "x", "s"), (2, "x", "t"), (3, "y", "s")], "doc_id long, prefix string, suffix string")
    assert sorted(tuple(r)[1:] for r in candidate_banks(cases, "prefix").collect()) == [(1, 3, 1, True), (2, 1, 2, True)]
    assert [r.guarded for r in candidate_banks(cases.withColumn("gap", F.lit("4")), "gap").collect()] == [False]  # one bank for different prefixes
    losses = spark.createDataFrame([("big", 8.0, 8), ("big", 8.0, 8), ("small", 6.0, 2)], "f string, l double, n long")
    assert tuple(family_macro(losses, "f", "l", "n").first()) == (2, round(22 / 18, 6), 2.0)
