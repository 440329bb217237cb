"""The ten operators against brute force: nulls, blanks, long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle import duck_rows, spark_rows

from pyspark.sql import functions as F

from seqloom.llm import decontaminate, pii, quality, queries, simhash, substring_dedup, topk, toxicity, url_filter, warc
from seqloom.plans.storage import Scratch
from seqloom.llm.sentencepiece_bpe import Encoder, Vocabulary, model_bytes, sentencepiece_decode, sentencepiece_encode

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, ids string, words string, value string, block long, fp string, cell long, hash long, __row long"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ITEM = prose(30, 100)
PASSAGE = prose(60, 200)
LONG = prose(30_000, 1)
TEXTS: list[tuple[int | None, str | None]] = [
    (1, prose(80, 2)),
    (2, prose(80, 2)),
    (3, prose(80, 2) + " extra"),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (None, prose(80, 2)),
    (7, "one two"),
    (7, "one two"),
    (8, LONG),
    (9, f"{prose(50, 3)} {ITEM} {prose(50, 4)}"),
    (10, f"{prose(20, 5)} {PASSAGE} {prose(20, 6)} {PASSAGE}"),
    (11, f"{prose(20, 7)} {PASSAGE}\n\n{prose(20, 8)}"),
    (12, "Mail ann.lee@example.co.uk or +44 (20) 7946-0958, card 4111 1111 1111 1111, host 10.0.0.255 and 999.1.1.1."),
    (13, "a@b a@b.c@d.e x@@y.z 1.2.3.4.5.6.7.8 +1 2 4111111111111112 😀 k@x.io"),
    (14, "Ünïcode  ▁x▁  日本語テキスト𝔘́ \x00\x7f\r\nend "),
    (15, "a" * 60_000),
    (16, f"{ITEM}"),
    (17, " ".join(ITEM.split()[:20])),
    (18, "same same " * 40),
    (19, "😀" * 50),
]


def frame(spark, rows=TEXTS, schema=DOCS):
    wide = [(i, t, None if k == 3 else "en", "s", None if t is None else len(t), 1, "x", "y", "z", 2, "f", 3, 4, 5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables, and one of empty ones."""
    at = {}
    r = random.Random(9)
    labels = [(k, int(k % 3 > 0), int(k % 7 == 0), "x") for k in range(1, 20)] + [(None, 1, 0, "x"), (2, None, None, "x"), (99, 1, 1, "x")]
    items = [(1, ITEM, "x"), (2, "too few", "x"), (3, None, "x"), (None, ITEM, "x"), (4, prose(12, 300), "x"), (1, ITEM, "x")]
    vectors = [(k, [r.uniform(-1, 1) for _ in range(8)], 0, 0) for k in range(400)] + [(k, [0.5] * 8, 0, 0) for k in range(400, 500)]
    vectors += [(500, None, 0, 0), (550, [None] * 8, 0, 0), (600, [float("nan")] * 8, 0, 0), (650, [0.0] * 8, 0, 0), (700, [float("inf")] * 8, 0, 0), (None, [1.0] * 8, 0, 0), (750, [1.0] * 3, 0, 0), (50, [0.5] * 8, 0, 0)]
    big = "<p>" + prose(400, 11) + "</p>"
    urls = ["http://A.Example.com/en/7x?q", "https://x.com/en/1", "http://b.net/de/8", "http://c.example.net/de/8", "ftp://o.org/es/#f", "http://spam-farm.ads.io/x", "nothing", None, "http://", "http://SPAM-FARM.io?x", "://com/en/"]
    pages = [(k, urls[k % len(urls)], big if k % 4 == 0 else None if k % 4 == 1 else f"<i>{k}</i>é", 0, "h") for k in range(44)] + [(40, urls[0], big, 0, "h")]
    make = {
        "documents": lambda rows: frame(spark, rows),
        "labels": lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int, words string"),
        "benchmark": lambda rows: spark.createDataFrame(rows, "item_id long, text string, shingle string"),
        "embeddings": lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id int"),
        "pages": lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string, payload int, host string"),
    }
    full = {"documents": TEXTS, "labels": labels, "benchmark": items, "embeddings": vectors, "pages": pages}
    for kind in ("full", "empty"):
        at[kind] = str(tmp_path_factory.mktemp(kind))
        for name, f in make.items():
            f(full[name] if kind == "full" else []).coalesce(2).write.parquet(f"{at[kind]}/{name}.parquet")
    return at, full


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tables, name):
    df = queries.queries()[name](spark, tables[0]["empty"])
    assert df.count() == 0 and df.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    got, want = spark_rows(queries.queries()[name](spark, sf)), duck_rows(queries.oracle_sql()[name], sf)
    assert got == want


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode("utf-8")).hexdigest()


# 1


@pytest.mark.parametrize("where", ["full", "sf"])
def test_op1_matches_the_library(spark, tables, sf, where):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file())
    at = tables[0]["full"] if where == "full" else sf
    want = Counter()
    for i, t in texts(spark, at):
        ids = sp.encode(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += 1
    assert Counter(map(tuple, queries.op1_sentencepiece(spark, at).collect())) == want


def test_op1_round_trip_and_small_caches(spark):
    df = sentencepiece_encode(frame(spark), queries.tokenizer_file(), slice_chars=100)
    again = sentencepiece_decode(df.withColumnRenamed("decoded", "first"), queries.tokenizer_file())
    assert again.where("first <> decoded").count() == 0 and again.count() == len(TEXTS)
    small, large = (Encoder(Vocabulary(queries.tokenizer_file()), n) for n in (3, 10**6))
    for text in ("one two three four five", LONG[:3000], " a  b "):
        assert small([text])[0].tolist() == large([text])[0].tolist()


def test_op1_turns_other_models_down(tmp_path):
    """A model file with another normaliser: the byte that says whether a space is put in front is set anew."""
    data = open(queries.tokenizer_file(), "rb").read()
    assert model_bytes(queries.tokenizer_file()) == data
    # normalizer_spec is field 3; within it add_dummy_prefix is field 3 (a varint): appended fields override
    (tmp_path / "other.model").write_bytes(data + bytes([0x1A, 2, 0x18, 0]))
    with pytest.raises(ValueError, match="not supported"):
        model_bytes(str(tmp_path / "other.model"))


# 2


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + width]) for k in range(len(w) - width + 1)}


def test_op2_brute_force(spark, tables):
    at, full = tables
    docs, items = {}, {}
    for i, t in TEXTS:
        docs.setdefault(i, set()).update(*(shingles(t, n) for n in range(1, 6)))
    for i, t, _ in full["benchmark"]:
        items.setdefault(i, set()).update(shingles(t, min(5, max(1, len((t or "").split())))))
    want = {(d, i, len(s & x), len(x)) for d, s in docs.items() for i, x in items.items() if d is not None and i is not None and x and len(s & x) >= 0.8 * len(x) - 1e-9}
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in queries.op2_decontaminate(spark, at["full"]).collect()}
    assert got == want and {d for d, *_ in want} >= {9, 16} and 17 not in {d for d, *_ in want}


def test_op2_short_and_mixed_items(spark):
    docs = [(1, "So: what is the  CAPITAL? of this"), (2, "what is the"), (3, "what is capital?"), (4, "x"), (5, None), (6, " ".join(f"w{k}" for k in range(50)))]
    items = [(1, "What is the capital?"), (2, "x"), (3, ""), (4, None), (5, "what is"), (6, "w1 w2 w3 w4 w5 w6 w7"), (7, "w9 w10"), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (None, "x")]
    found = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(1, 1, 1, 1), (4, 2, 1, 1), (1, 5, 1, 1), (2, 5, 1, 1), (3, 5, 1, 1), (6, 6, 3, 3), (6, 7, 6, 6)}
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in found.collect()} == want


def test_drop_contaminated_keeps_clean_rows_and_columns(spark, tables):
    items = spark.read.parquet(f"{tables[0]['full']}/benchmark.parquet")
    docs = frame(spark, [*TEXTS, (None, f"x {ITEM} y"), (1, ITEM)])
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left == Counter((i, t) for i, t in TEXTS if i not in (9, 16))


# 3 and 10


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"))
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_op3_ranks_held_out_documents(spark):
    at = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, at).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    test = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    s, y, p = (np.array(x) for x in zip(*test, strict=True))
    assert auc(s, y) > 0.85
    assert ((p == 1)[y == 1].mean() + (p == 0)[y == 0].mean()) / 2 > 0.75


def test_op3_edge_rows(spark, tables):
    rows = queries.op3_quality(spark, tables[0]["full"]).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    x = np.array([quality.features(t) for _, t in TEXTS])
    assert np.isfinite(x).all()
    one = quality.fit(x, np.ones(len(x), bool))
    assert np.allclose(one.score(x), quality.THRESHOLD)


def test_op3_fit_against_plain_python():
    """The same pairs by plain gradient steps in Python give the same order of scores and the same threshold."""
    r = np.random.default_rng(2)
    x = r.normal(size=(60, quality.FEATURES))
    good = x[:, 0] + 0.5 * x[:, 3] + r.normal(size=60) * 0.3 > 0
    m = quality.fit(x, good, pairs=400, steps=2)
    wide = [[float(v > c) for j, v in enumerate(row) for c in m.cuts[j]] + [(v - a) / b for v, a, b in zip(row, m.centre, m.spread, strict=True)] for row in x.tolist()]
    pick = np.random.Generator(np.random.PCG64(7))
    up, down = pick.choice(np.flatnonzero(good), 400), pick.choice(np.flatnonzero(~good), 400)
    diff = [[min(8, max(-8, a)) - min(8, max(-8, b)) for a, b in zip(wide[i], wide[j], strict=True)] for i, j in zip(up, down, strict=True)]

    def slope(w):
        out = [quality.RIDGE * v for v in w]
        for d in diff:
            p = 1 / (1 + math.exp(sum(a * b for a, b in zip(d, w, strict=True))))
            for k, v in enumerate(d):
                out[k] -= v * p / len(diff)
        return out

    assert max(map(abs, slope(m.weights.tolist()))) < 1e-4  # the minimum of a convex loss
    raw = [sum(a * b for a, b in zip(map(lambda v: min(8, max(-8, v)), row), m.weights, strict=True)) for row in wide]
    scores = [1 / (1 + math.exp(-(v - m.shift))) for v in raw]
    assert np.allclose(scores, m.score(x)) and np.isclose(m.shift + math.log(0.3 / 0.7), np.quantile(raw, np.linspace(0.005, 0.995, 199))).any()


def test_op3_op10_repeated_ids_and_contradicting_labels(spark):
    rows = [(k, f"{'idiot scum' if k % 4 == 0 else 'calm'} {prose(30, k)}") for k in range(80)] + [(4, prose(30, 4)), (8, None)] * 50
    labels = [(k, int(k % 3 > 0), int(k % 4 == 0), "x") for k in range(80)] + [(4, 0, 0, "x"), (4, 1, 1, "x")]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, words string")
    for module, query in ((quality, quality.classify), (toxicity, toxicity.score)):
        a, b = (query(d, k) for d, k in ((docs, known), (docs.repartition(7), known.repartition(3))))
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect())) and a.count() == len(rows), module
        assert query(docs, known.limit(0)).count() == len(rows)
    found = {r.doc_id: r.toxic for r in toxicity.score(docs, known).where("doc_id NOT IN (4, 8)").collect()}
    assert all(t == int(i % 4 == 0) for i, t in found.items())


def test_op10_chain_against_plain_python():
    """Weights are the minimum of each category's ridge loss over the words and the earlier out-of-fold chances; kinds split toxic rows."""
    r = np.random.default_rng(1)
    present = [sorted(set(r.integers(0, 5, 3).tolist())) for _ in range(90)]
    toxic = np.array([int(0 in p or 1 in p) for p in present])
    marks = np.column_stack([toxicity.kinds(toxicity._dense(present, 5), toxic == 1), toxic])
    assert (marks[:, 0] + marks[:, 1] == toxic).all() and 0 < marks[:, 0].sum() < toxic.sum()
    fold = np.arange(90) % toxicity.FOLDS
    chain = toxicity.fit_chain({str(k): k for k in range(5)}, present, marks, fold)
    chance = lambda x, w: 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, w, strict=False)) + w[-1])))
    x = [[float(k in p) for k in range(5)] for p in present]
    for n, w in enumerate(chain.weights):
        y = marks[:, n].tolist()
        for k in range(len(w)):
            slope = sum((chance(row, w) - t) * (row[k] if k < len(row) else 1) for row, t in zip(x, y, strict=True)) + (toxicity.RIDGE if k < len(w) - 1 else 1e-6) * w[k]
            assert abs(slope) < 1e-3
        unseen = []
        for f in range(toxicity.FOLDS):
            mine = [i for i in range(90) if fold[i] != f]
            unseen.append(toxicity._logistic(np.array([x[i] for i in mine]), np.array([float(y[i]) for i in mine])))
        x = [[*row, chance(row, unseen[fold[i]])] for i, row in enumerate(x)]
    assert len(chain.predict(present)[0]) == 3


def test_op10_finds_held_out_toxic_documents(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    fold = "pmod(crc32(cast(doc_id as string)), 5)"
    rows = toxicity.score(docs, labels.where(f"{fold} <> 0")).join(labels.where(f"{fold} = 0").withColumnRenamed("toxic", "label"), "doc_id").collect()
    y, p = np.array([r.label for r in rows]), np.array([r.toxic for r in rows])
    assert p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.01  # 3300 labels; all are found with the 16000 of a larger table


def test_op10_chain_feeds_earlier_probabilities(spark, tables):
    r = np.random.default_rng(0)
    present = [sorted(set(r.integers(0, 6, 3))) for _ in range(300)]
    first = np.array([0 in p for p in present], int)
    second = np.array([(0 in p) or (1 in p) for p in present], int)
    chain = toxicity.fit_chain({str(k): k for k in range(6)}, present, np.column_stack([first, second]), np.arange(300) % 3)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][6] > 0.5
    rows = queries.op10_toxicity(spark, tables[0]["full"]).collect()
    assert len(rows) == len(TEXTS) and all(0 <= x.p_toxic <= 1 for x in rows)
    kept = toxicity.reject(frame(spark), spark.read.parquet(f"{tables[0]['full']}/labels.parquet"))
    assert kept.columns == frame(spark).columns


# 4


def test_op4_brute_force(spark, tables):
    at, full = tables
    v = [(i, np.floor(256 * np.array(np.float32(x), float)).astype(int)) for i, x, *_ in full["embeddings"] if i is not None and x is not None and len(x) == 8 and None not in x and np.isfinite(x).all()]
    want = set()
    for q in {i for i, _ in v if i % 50 == 0}:
        mine = [x for i, x in v if i == q]
        best = sorted((-int(m @ x), i) for m in mine for i, x in v if i != q)
        if len(mine) == 1:
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best[:5], 1)}
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op4_topk(spark, at["full"]).collect()}
    assert {g for g in got if g[0] != 50} == want and {g[1] for g in got if g[0] == 50} == {1, 2, 3, 4, 5}


def test_op4_small_buckets_and_few_candidates(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, (r.normal(size=6) * r.uniform(0.1, 3)).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, n in (("CHUNK", 16), ("QUERY_BLOCK", 4), ("LEADERS", 10), ("HELD_BLOCKS", 2), ("GROUPS", 3)):
        monkeypatch.setattr(topk, name, n)
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_products(df, df.vec_id % 10 == 0, k=4).collect()}
    v = {k: np.floor(256 * np.array(x)).astype(int) for k, x in rows}
    want = {(q, n, i, -s) for q in v if q % 10 == 0 for n, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:4], 1)}
    assert got == want
    few = topk.top_products(df.where("vec_id < 3"), df.vec_id >= 0).collect()
    assert sorted((x.query_id, x.rank) for x in few) == [(q, n) for q in range(3) for n in (1, 2)]


def test_op4_large_components_mixed_widths_and_column_names(spark):
    r = np.random.default_rng(6)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=(4, 4, 7, 1)[k % 4]) * 10 ** r.uniform(-2, (7, 7, 3, 12)[k % 4])], 1, 2.0, "a") for k in range(240)]
    rows += [(k, [1e7, -1e7, 1e7, 3e30], 1, 2.0, "a") for k in (240, 241, 242)] + [(243, [], 0, 0.0, "b"), (250, [], 0, 0.0, "b"), (260, [1e7] * 4, 1, 1.0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, v double, width string")
    got = {(x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_products(df, df.vec_id % 10 == 0).collect()}
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e, *_ in rows}
    want = set()
    for q in (i for i in v if i % 10 == 0):
        score = lambda i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[q], v[i], strict=True))))  # noqa: B023, E731
        best = sorted((-score(i), i) for i in v if i != q and len(v[i]) == len(v[q]))
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best[:5], 1)}
    assert got == want and {2**63 - 1, 0} <= {g[3] for g in got}


# 5


def test_op5_round_trip(spark, tables):
    at, full = tables
    groups = {}
    for i, _, html, *_ in full["pages"]:
        groups.setdefault((html or "").encode(), []).append(i)
    want = Counter()
    for i, _, html, *_ in full["pages"]:
        data = (html or "").encode()
        kept = max(groups[data]) if len(data) >= 1000 else i
        want[i, len(data), hashlib.sha1(data).hexdigest(), "response" if kept == i else "revisit", None if kept == i else kept] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op5_warc(spark, at["full"]).collect()) == want


def test_op5_joins_give_the_same_rows(spark, tables):
    """Repeated digests by broadcast; hot ones by broadcast and the others by a shuffle; all by a shuffle."""
    pages, seen = spark.read.parquet(f"{tables[0]['full']}/pages.parquet"), []
    pages = pages.unionByName(pages.where("html IS NOT NULL AND page_id % 8 = 0").withColumns({"page_id": F.col("page_id") + 1000, "html": F.concat("html", F.repeat(F.lit("x"), 1000))}))
    for hot, limit in ((10, 100), (10, 1), (10**6, 0)):
        made = warc.with_record_types(pages, Scratch(spark, "warc"), hot, limit)
        seen.append(Counter((r.page_id, r.url, bytes(r.payload), r.refers_to) for r in made.collect()))
    assert seen[0] == seen[1] == seen[2] and any(k[3] for k in seen[0])


def test_warc_format():
    records = [warc.format_record(k, "http://x/ y", f"<p>{k}</p>".encode() * 50, None if k % 3 else 7) for k in range(40)]
    data = warc.write_archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICT_FRAME and list(warc.read_archive(data)) == records
    assert warc.parse_record(records[1])["payload"] == b"<p>1</p>" * 50 and warc.parse_record(records[3])["refers_to"] == 7
    for bad in (records[1][:-1], records[1].replace(b"<p>1", b"<p>2", 1), records[1].replace(b"WARC-Date", b"WARC-Dat", 1), b"junk"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    for bad in (data[:-3], data + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    assert list(warc.read_archive(warc.write_archive([b"x"]))) == [b"x"]


# 6

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    total = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d)))
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


@pytest.mark.parametrize("where", ["full", "sf"])
def test_op6_base_spans(spark, tables, sf, where):
    at = tables[0]["full"] if where == "full" else sf
    want = Counter()
    for i, t in texts(spark, at):
        s = base_spans(t or "")
        want[i, *(sum(x[3] == k for x in s) for k, _ in BASE), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in s))] += 1
    rows = queries.op6_pii(spark, at).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    for r in rows:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
        assert sum(k == "email" for k, *_ in spans) == r.n_email


def test_op6_terms_that_reveal_an_entity(spark):
    rows = [(k, f"{prose(30, 400 + k)} quartermaster zed@corp.example {prose(30, 500 + k)}") for k in range(6)] + [(k, prose(200, k)) for k in range(10, 30)]
    df = frame(spark, rows)
    added = {r.doc_id: [x.value for x in r.added] for r in pii.spans(df).collect()}
    assert all("quartermaster" in added[k] for k in range(6)) and not any(added[k] for k in range(10, 30))
    clean = {r.doc_id: r for r in pii.sanitise(df, length_col="n_chars").collect()}
    for k in range(6):
        assert "quartermaster" not in clean[k].text and "zed@" not in clean[k].text and "<EMAIL>" in clean[k].text and clean[k].n_chars == len(clean[k].text)
    assert all(clean[k].text == prose(200, k) for k in range(10, 30)) and pii.sanitise(df).columns == df.columns


# 7


def kept_words(rows, window):
    first, words = {}, {}
    places = sorted(((-1 if i is None else i), k) for k, (i, _) in enumerate(rows))
    for i, k in places:
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[k][1] or "")
        words[k] = w
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, k in places:
        w, gone = words[k], set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone |= set(range(s, s + window))
        out.append((rows[k][0], len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    return Counter(out)


@pytest.mark.parametrize("where", ["full", "sf"])
def test_op7_brute_force(spark, tables, sf, where):
    at = tables[0]["full"] if where == "full" else sf
    want = kept_words(texts(spark, at), 20)
    assert Counter(map(tuple, queries.op7_substring_dedup(spark, at).collect())) == want
    assert sum(n for (_, _, gone, _), n in want.items() if gone)


def test_op7_small_blocks(spark):
    rows = [(k, prose(40, k % 4) + " " + prose(15, 77)) for k in range(24)]
    found = substring_dedup.remove_repeated_windows(frame(spark, rows), window=6, block_bytes=500).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in found) == kept_words(rows, 6)


def test_op7_compares_words_not_hashes(spark):
    """Complementary Thue-Morse words collide under every polynomial hash modulo 2 ** 64."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    rest = prose(19, 50)
    rows = [(1, f"{word} {rest}"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} {rest}")]
    found = substring_dedup.remove_repeated_windows(frame(spark, rows)).collect()
    assert [r.n_removed for r in found] == [0, 0] and {r.kept for r in found} == {t for _, t in rows}


@pytest.mark.parametrize("window", [1, 2, 3, 20])
def test_op7_periodic_and_overlapping_texts(spark, window):
    r = random.Random(window)
    rows = [(k, " ".join(r.choice("ab") for _ in range(60))) for k in range(6)] + [(6, "a " * 70), (7, "a b " * 40), (None, "a b\tc  " * 30), (8, "b")]
    found = substring_dedup.remove_repeated_windows(frame(spark, rows).repartition(3), window=window, block_bytes=150).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, sha(x.kept)) for x in found) == kept_words(rows, window)


def test_queries_leave_only_their_result(spark, tables):
    before = {t.name for t in spark.catalog.listTables()}
    root = queries.op7_substring_dedup(spark, tables[0]["full"])
    made = queries.queries()["op7_substring_dedup"](spark, tables[0]["full"])
    assert made.count() == root.count() and len(made.inputFiles()) and all("/result/" in f for f in made.inputFiles())
    assert len({t.name for t in spark.catalog.listTables()} - before) == 1  # that of the call without an owner


# 8


def test_op8_rules(spark, tables):
    at, full = tables
    want = set()
    for i, url, *_ in full["pages"]:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        listed = bool(set(host.split(".")) & set(url_filter.LISTED_NAMES))
        want.add((i, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if listed else "allow"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op8_url_filter(spark, at["full"]).collect()}
    assert got == want and {w[4] for w in want} == {"allow", "block"}


@pytest.mark.parametrize(("shard_keys", "most"), [(1 << 20, 8_000_000), (200, 8_000_000), (200, 0), (1 << 20, 0)])
def test_op8_cascade_is_exact(spark, monkeypatch, shard_keys, most):
    """One shard and many, levels broadcast and sent to their shards' rows; every column kept, whatever its name."""
    monkeypatch.setattr(url_filter, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", most)
    monkeypatch.setattr(url_filter, "PART_ROWS", 300)  # more parts than the least
    keys = spark.range(6_000).selectExpr("concat('k', id) AS key", "id AS h1", "cast(id AS string) AS h2", "2 AS listed2", "array(id) AS shard")
    rows = keys.unionByName(keys.where("h1 = 18").join(spark.range(3_000)).drop("id")).unionByName(spark.sql("SELECT cast(null AS string) AS key, -1L AS h1, 'x' AS h2, 2 AS listed2, array(1L) AS shard"))
    listed = keys.where("pmod(xxhash64(key), 9) = 0").select("key").unionByName(spark.sql("SELECT 'nowhere' AS key UNION ALL SELECT null"))
    marked = url_filter.in_list(rows, "key", listed)
    assert marked.columns == [*rows.columns, "listed"] and marked.count() == 9_001
    assert marked.where("listed <> (key IS NOT NULL AND pmod(xxhash64(key), 9) = 0) OR concat('k', h1) <> key OR shard[0] <> h1 AND key IS NOT NULL OR h2 <> cast(h1 AS string) AND key IS NOT NULL").count() == 0
    clash = rows.limit(5).withColumn("listed", F.lit("mine"))
    assert url_filter.in_list(clash, "key", listed).columns == [*clash.columns, "listed_"]
    assert url_filter.in_list(rows, "key", listed.limit(0)).where("listed").count() == 0
    assert url_filter.in_list(rows.limit(0), "key", listed).count() == 0


# 9


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in rows)


@pytest.mark.parametrize("where", ["full", "sf"])
def test_op9_brute_force(spark, tables, sf, where):
    at = tables[0]["full"] if where == "full" else sf
    rows = [(i, fingerprint(t)) for i, t in texts(spark, at)]
    assert Counter(map(tuple, queries.op9_simhash(spark, at).collect())) == components(rows)


def test_op9_links_of_close_fingerprints(spark):
    r = random.Random(8)
    seeds = [r.getrandbits(64) for _ in range(60)]
    fps = {s ^ sum(1 << b for b in r.sample(range(64), n)) for s in seeds for n in (0, 0, 1, 2, 3, 4) for _ in range(3)} | {0, 1, 3, 7, 2**64 - 1, 2**63}
    signed = [(f - (f >> 63 << 64), 1) for f in fps]
    links = {(a % 2**64, b % 2**64) for a, b in simhash.links(spark.createDataFrame(signed, "fp long, least long")).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)

    def classes(edges):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {f: find(f) for f in fps}

    every = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert classes(links) == classes(every) and every


def test_op9_keeps_one_row_of_each_group(spark):
    df = frame(spark, [*TEXTS, (7, "one two"), (None, "only here once"), (None, "only here once")])
    kept = simhash.keep_one(df)
    rows = [(i, fingerprint(t)) for i, t in ((r.doc_id, r.text) for r in df.collect())]
    groups = {(f, c) for _, f, c in components(rows)}
    left = kept.collect()
    assert kept.columns == df.columns and len(left) == len({c if c is not None else f for f, c in groups})
    assert {1, 4, 7} <= {r.doc_id for r in left} and not {2, 5, 6} & {r.doc_id for r in left}
