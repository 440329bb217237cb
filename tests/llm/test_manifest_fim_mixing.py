"""Operators 11 to 13 against brute force: nulls, blanks, long texts, ties, repeated rows, clashing columns, hot groups."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import TEXTS, frame

from seqloom.llm import fill_in_middle, merkle, mixing
from seqloom.llm.places import places
from seqloom.plans.storage import Scratch


def sha(x: str) -> str:
    return hashlib.sha256(x.encode("utf-8")).hexdigest()


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 11


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode('utf-8'))}:{x}"


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str | None, bool]]]]:
    """The root, and each leaf's siblings with their sides."""
    proofs: list[list] = [[] for _ in leaves]
    level, under = leaves, [[k] for k in range(len(leaves))]
    while len(level) > 1:
        above, held = [], []
        for k in range(0, len(level), 2):
            run = level[k : k + 2]
            for at, side in ((k, 1), (k + 1, 0)):
                if at < len(level):
                    other = run[side] if len(run) > side else None
                    for leaf in under[at]:
                        proofs[leaf].append((other, side == 0))
            above.append(sha("".join(run)))
            held.append(sum(under[k : k + 2], []))
        level, under = above, held
    return level[0], proofs


def brute_manifest(rows) -> Counter:
    groups = defaultdict(list)
    for i, source, lang, n, text in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        leaf, claimed = (sha("".join(map(field, (i, source, lang, m, text)))) for m in (n, n + 1 if tampered else n))
        groups[lang].append((i is not None, i or 0, leaf, claimed, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: (sorted(groups[g], key=lambda r: r[:3]), *tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])])) for g in names}
    root, upper = tree([made[g][1] for g in names])
    out = Counter()
    for g, above in zip(names, upper, strict=True):
        leaves, subroot, proofs = made[g]
        for (_, _, leaf, claimed, i), proof in zip(leaves, proofs, strict=True):
            node = claimed
            for other, left in proof + above:
                node = sha((other or "") + node if left else node + (other or ""))
            out[i, leaf, subroot, root, sha("".join(o or "" for o, _ in proof + above)), node, node == root] += 1
    return out


@pytest.mark.parametrize("height,pack", [(1, 2), (2, 8), (10, 4096)])
def test_merkle_brute_force(spark, height, pack):
    """Blocks of two leaves force many rounds; a hot group of 60, single groups, a null one, repeated rows and null ids."""
    rows = [(i, "s", None if k % 9 == 4 else "en", None if t is None else len(t), t) for k, (i, t) in enumerate(TEXTS)]
    rows += [(1000 + k, None, "hot", k, f"text {k}") for k in range(60)] + [(2000, "é", f"x{k}", 1, "") for k in range(5)] + [(7, "s", "en", 3, "abc")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(3)
    claim = {"n_chars": F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)}
    made = merkle.manifest(df, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], claim, height, pack)
    got = rows_of(merkle.digests(merkle.verified(made)), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = brute_manifest(rows)
    assert Counter(got) == want
    assert {r[6] for r in want} == {True, False}


def test_merkle_single_leaf(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, lang string")
    r = merkle.verified(merkle.manifest(df, "doc_id", "lang", ["doc_id", "lang"])).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and not r.proof


# 12


def brute_fim(i, text) -> tuple:
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = sha(f"1:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle_brute_force(spark):
    rows = TEXTS + [(100 + k, f"a<b <P {k}<< S> M> é\n\n{'x' * k}<") for k in range(150)] + [(300, "has <M> inside"), (301, "<S>"), (302, "z")]
    df = frame(spark, rows).withColumn("n", F.lit("clash")).withColumn("made", F.lit(1))
    made = fill_in_middle.fill_in_middle(df)
    assert {"lang", "n_chars", "made", "output"} <= set(made.columns) and "text" not in made.columns
    got = rows_of(fill_in_middle.digests(made), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert Counter(got) == Counter(brute_fim(i, t) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_streams(monkeypatch):
    """Both passes take matches one at a time: no list of them is ever made."""
    alive, most = 0, 0

    class Match:
        def __init__(self, m):
            nonlocal alive, most
            self.m, alive = m, alive + 1
            most = max(most, alive)

        def end(self):
            return self.m.end()

        def __del__(self):
            nonlocal alive
            alive -= 1

    class Unit:
        @staticmethod
        def finditer(text):
            return (Match(m) for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text))

    monkeypatch.setattr(fill_in_middle, "UNIT", Unit)
    assert fill_in_middle.transformed("one, two; three " * 500, [1700, 2900, 0, 50])[:2] == (4000, "psm")
    assert most <= 3


# 13


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        full = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) >= most * sizes[s]}
        if not full:
            return out | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def mixed_rows():
    r = [(i, t, None if k % 6 == 5 else f"s{k % 4}") for k, (i, t) in enumerate(TEXTS)]
    r += [(1000 + k, "w " * (k % 300), "hot") for k in range(2000)] + [(5000, "a b c", "tiny"), (5001, "", "empty"), (5002, None, "empty")]
    return r + [(6000, "repeated row of seven words in all", "s1")] * 400


def test_mixing_targets_and_bounds(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    sizes = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, s in rows]
    totals = Counter()
    for _, s, n in sizes:
        totals[s] += n
    totals = dict(totals) | {"empty": 0}
    want = brute_targets(totals)
    made = mixing.mix(df, shard=2**12)
    got = rows_of(made, "doc_id", "source", "size", "source_size", "target", "whole", "pieces")
    assert Counter((i, s, n) for i, s, n, *_ in got) == Counter(sizes)
    took = Counter()
    for _, s, n, total, target, whole, pieces in got:
        assert total == totals[s] and target == pytest.approx(want[s])
        assert all(0 <= a < b <= n for a, b in pieces) and all(p[1] <= q[0] for p, q in zip(pieces, pieces[1:], strict=False))
        taken = whole * n + sum(b - a for a, b in pieces)
        assert taken <= 2 * n
        took[s] += taken
    for s, total in totals.items():
        assert abs(took[s] - want[s]) <= 2 * mixing.BLOCK + 0.01 * want[s], s
    assert 0 < want["tiny"] <= 6 and want["empty"] == 0
    again = mixing.taken(mixing.mix(df.repartition(5), shard=2**12))
    assert Counter(rows_of(again, "doc_id", "size", "source_size", "target", "taken")) == Counter(rows_of(mixing.taken(made), "doc_id", "size", "source_size", "target", "taken"))


def test_sainte_lague_equals_enumeration(spark):
    """More seats than members, fewer, none; equal votes; members without votes."""
    import random

    r = random.Random(3)
    members, houses = [], []
    for g, (m, house) in enumerate([(1, 7), (5, 0), (40, 3), (40, 1000), (300, 299), (8, 100), (30, 31)]):
        votes = [10] * m if g in (4, 5) else [r.choice([0, 1, 3, 10, 500, 20000]) for _ in range(m - 1)] + [7]
        members += [(f"g{g}", k, v) for k, v in enumerate(votes)]
        houses.append((f"g{g}", house))
    scratch = Scratch(spark, "seats")
    got = {(x.grp, x.member): x.seats for x in mixing.apportion(spark.createDataFrame(members, "grp string, member long, votes long"), spark.createDataFrame(houses, "grp string, house long"), scratch, "t").collect()}
    for g, house in houses:
        here = [(k, v) for x, k, v in members if x == g]
        quotients = sorted((-v / (2 * j + 1), k) for k, v in here if v for j in range(house))[:house]
        seats = Counter(k for _, k in quotients)
        assert {k: got[g, k] for k, _ in here} == {k: seats[k] for k, _ in here}, g


def test_places(spark):
    rows = [(g, k % 7, 1 + k % 3) for g in ("a", "b") for k in range(50)] + [("c", None, 2)] * 20
    df = spark.createDataFrame(rows, "g string, x int, w long")
    got = places(df, ["g"], ["x"], Scratch(spark, "p"), "n", weight="w").collect()
    for g in "abc":
        here = sorted((r.place, -1 if r.x is None else r.x, r.w) for r in got if r.g == g)
        at = 0
        for place, _, w in here:
            assert place == at
            at += w
        assert [x for _, x, _ in here] == sorted(x for _, x, _ in here)
