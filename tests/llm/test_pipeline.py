"""The pipeline's stages, each judged on what its predecessor kept."""

from __future__ import annotations

from collections import Counter

import pytest
from test_near_copies import kept_of
from test_operators import shingles, tables  # noqa: F401

from seqloom.llm.queries import tokenizer_file

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        a, b = ({r.doc_id: r for r in x.collect()} for x in (before, docs))
        seen[name] = (a, b)
        assert docs.columns == columns or name == "sentencepiece"
        assert b.keys() <= a.keys() and docs.count() == len(b)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    a, b = seen["toxicity"]
    gone = a.keys() - b.keys()  # a table of 200 documents has labels for few toxic ones
    assert gone and len(b) >= 0.85 * len(a) and all(labels.get(i, 1) for i in gone)
    a, b = seen["simhash_dedup"]
    assert b.keys() == kept_of([(i, r.text) for i, r in a.items()])  # five words and a similarity of 0.8, over all pairs
    a, b = seen["decontaminate"]
    leaks = {i for i, r in a.items() if any(x and len(shingles(r.text) & x) >= 0.8 * len(x) - 1e-9 for x in items)}
    assert a.keys() - b.keys() == leaks
    a, b = seen["pii"]
    assert a.keys() == b.keys() and all(r.n_chars == len(r.text) or r.text == a[i].text for i, r in b.items())
    a, b = seen["sentencepiece"]
    assert a.keys() == b.keys() and all(r.decoded == a[i].text.replace("▁", " ") or a[i].text != a[i].text.strip() for i, r in b.items())


def test_stages_on_empty_and_edge_tables(spark, tables):
    """Empty tables give empty ones; nulls, blanks, long texts, repeated rows and clashing columns pass every stage."""
    for kind in ("empty", "full"):
        at = tables[0][kind]
        docs = spark.read.parquet(f"{at}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, at).collect()
            assert kind == "full" or not made
            assert name == "sentencepiece" or stage(spark, docs, at).columns == columns
            if name in ("pii", "sentencepiece"):  # no document goes
                assert Counter(r.doc_id for r in made) == Counter(r.doc_id for r in docs.collect())


def test_encode_stage_gives_the_library_ids(spark, tables):
    import sentencepiece

    at = tables[0]["full"]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    docs = spark.read.parquet(f"{at}/documents.parquet")
    want = Counter((r.doc_id, tuple(sp.encode(r.text or "")), sp.decode(sp.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, at).collect()) == want


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
