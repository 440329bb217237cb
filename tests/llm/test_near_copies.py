"""Near copies by five-word Jaccard similarity, against every pair."""

from __future__ import annotations

import random

import corpus_pipeline
from test_operators import WORDS, prose

from seqloom.llm import near_copies
from seqloom.plans.storage import Scratch


def five(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b)


def kept_of(rows: list[tuple[int, str | None]]) -> set[int]:
    """The smallest id of each component over all pairs of similarity 0.8 or more."""
    sets, least = {i: five(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {root(i) for i in ids}


def planted() -> list[tuple[int, str | None]]:
    """120 texts of 300 words, each with a copy that has 0 to 9 words replaced; blank and short texts."""
    r, rows = random.Random(11), []
    for k in range(120):
        words = prose(300, 9000 + k).split()
        rows.append((2 * k, " ".join(words)))
        for at in r.sample(range(300), k % 10):
            words[at] = r.choice(WORDS) + "x"
        rows.append((2 * k + 1, " ".join(words)))
    return [*rows, (900, None), (901, " "), (902, "one two"), (903, "One  two"), (904, "one three")]


def test_planted_near_copies(spark):
    rows = planted()
    kept = {x.doc_id for x in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = kept_of(rows)
    assert kept == want and len(want) < 160


def templates(pairs: int, seed: int, shared: int, own: int, changed: int) -> list[tuple[int, str]]:
    """Pairs that share a template with all others: some words of each document are its pair's own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    template, rows = [word() for _ in range(shared)], []
    for k in range(pairs):
        one = [*template, *(word() for _ in range(own))]
        two = list(one)
        for at in range(changed):
            two[shared + own - 1 - at * 6] = word()
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    return rows


def test_pairs_within_a_template(spark):
    """150 pairs of similarity above 0.8, each at about 0.75 to all others: none is lost, though all crowd the same keys."""
    rows = templates(150, 5, 600, 95, 15)
    sets = {i: five(t) for i, t in rows}
    near = [jaccard(sets[2 * k], sets[2 * k + 1]) for k in range(150)]
    assert min(near) >= 0.8 and max(near) < 0.85 and 0.7 < jaccard(sets[0], sets[2]) < 0.79
    kept = {x.doc_id for x in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * k for k in range(150)}


def test_crowds_beyond_the_limit(spark, monkeypatch):
    """Shingles that more nodes meet in than are compared pair by pair."""
    monkeypatch.setattr(near_copies, "CROWD", 4)
    rows = templates(60, 6, 600, 95, 15)
    kept = {x.doc_id for x in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == kept_of(rows)


def test_sets_without_a_rare_shingle(spark):
    """200 sets in one key, every shingle of which more than CROWD have: no pair of 0.8 or more is missing among the candidates."""
    r = random.Random(4)
    sets = [frozenset(r.sample(range(40), 20)) for _ in range(180)]
    sets += [s - {min(s)} | {r.choice(sorted(set(range(40)) - s))} for s in sets[40:60]]
    names = [b"%03d" % k for k in r.sample(range(200), 200)]
    want = {(max(names[i], names[j]), min(names[i], names[j])) for i in range(200) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8 - 1e-9}
    assert len(want) >= 20 and min(sum(t in s for s in sets) for t in range(40)) > near_copies.CROWD
    nodes = spark.createDataFrame([(n, 20, [7]) for n in names], "node binary, n int, keys array<long>")
    held = spark.createDataFrame([(n, sorted(s)) for n, s in zip(names, sets, strict=True)], "node binary, hashes array<long>")
    parts = spark.createDataFrame([], "node binary, component binary")
    got = near_copies._crowded(nodes, parts, held, 0.8, Scratch(spark, "crowded"))
    assert want <= {(bytes(x.a), bytes(x.b)) for x in got.select("a", "b").collect()}


def test_other_columns_and_empty_tables(spark):
    rows = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (None, "a b c d e f", 3, "z"), (2, None, 4, None), (None, " ", 5, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, hashes string")
    got = near_copies.keep_one(df)
    assert got.columns == df.columns and sorted((x.doc_id, x.text) for x in got.collect()) == [(1, "a b c d e f"), (2, None)]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_stage_over_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, sf).select("doc_id").collect()} == kept_of(rows)
