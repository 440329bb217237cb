"""Terms that reveal rare entities, wherever they stand in a document."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
import regex
from test_operators import TEXTS, WORDS, base_spans, frame, prose, texts

from seqloom.llm import pii


def test_rare_entities_and_far_terms(spark):
    once = f"Harbourmaster {prose(90, 1)} ann@corp.example {prose(90, 2)} harbourmaster"
    twice = [f"lamplighter {prose(90, 3 + k)} bob@corp.example {prose(9, 6)} 𝔘lamplighter {prose(60, 8)} Lamplighter" for k in range(2)]
    rows = [(0, once), (1, twice[0]), (2, twice[1]), *[(k, prose(200, k)) for k in range(10, 70)]]
    rows += [(70, f"watchmaker {prose(30, 4)} cat@corp.example"), *[(k, f"watchmaker {prose(30, k)}") for k in range(71, 90)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r.doc_id: {(x.start, x.end, x.value): x.share for x in r.added} for r in pii.spans(df).collect()}
    n = len(rows)

    def places(text, word):
        return {(k, k + len(word), text[k : k + len(word)]) for k in range(len(text)) if text[k : k + len(word)].lower() == word and text[k - 1 : k] != "𝔘"}

    for k, word, n_both in ((0, "harbourmaster", 1), (1, "lamplighter", 2), (2, "lamplighter", 2)):
        want, p = places(rows[k][1], word), n_both / n
        assert len(want) == 2 and want <= added[k].keys()
        assert all(math.isclose(added[k][x], 1 + math.log2((n_both + p) / (n_both + 1)) / -math.log2(p)) for x in want)
    assert not any(x[2] == "watchmaker" for x in added[70]) and not any(added[k] for k in range(10, 70))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(w not in clean[k].lower().replace("𝔘lamplighter", "") for k in range(3) for w in ("harbourmaster", "lamplighter"))
    assert clean[0].count("<WORD>") >= 2 and "watchmaker" in clean[70]


def disclosed(rows: list[tuple]) -> Counter:
    """Of each row with base spans: places of its telling terms with their disclosure, by counting everything."""
    term = regex.compile(r"[\p{L}\p{N}]{3,}")
    n_term, n_entity, docs = Counter(), Counter(), []
    for i, t in rows:
        t = t or ""
        base = base_spans(t)
        entities = {(k, t[a:b].lower()) for a, k, b, _ in base}
        free = [m for m in term.finditer(t) if pii.FILLER not in t[max(m.start() - 1, 0) : m.end() + 1] and not any(a < m.end() and m.start() < b for a, _, b, _ in base)]
        n_term.update({m[0].lower() for m in free})
        n_entity.update(entities)
        docs.append((i, entities, free))
    both = Counter((e, w) for _, entities, free in docs for e in entities for w in {m[0].lower() for m in free})
    out, n = Counter(), max(len(rows), 2)
    for i, entities, free in docs:
        places = []
        for m in free:
            shares = [0.0]
            for e in entities:
                w, p = m[0].lower(), min(1.0, n_entity[e] / n)
                if p < 1:
                    shares.append(1 + math.log2((both[e, w] + p) / (n_term[w] + 1)) / -math.log2(p))
            if max(shares) >= pii.GENERALISE:
                places.append((m.start(), m.end(), m[0], round(max(shares), 9)))
        out[i, tuple(sorted(places))] += 1
    return out


def crowded() -> list[tuple[int, str]]:
    """Entities in several documents, in copies, beside and within words, overlapping; terms seen twice in a document."""
    r = random.Random(3)
    people = [f"p{k}@x{k % 3}.org" for k in range(12)] + ["10.0.0.7", "+44 20 7946 0958", "4111 1111 1111 1111"]
    rows = []
    for k in range(60):
        words = [r.choice(WORDS[:60]) for _ in range(30)] + [f"only{k}", f"only{k}", f"pair{k // 2}", "Straße"]
        words += r.sample(people, r.randint(0, 4))
        r.shuffle(words)
        rows.append((k, " ".join(words)))
    rows += [(60, rows[5][1]), (61, rows[5][1]), (62, "xx10.0.0.7yyy a1@b.c.d2@e.f +1-4111-1111-1111-1111 zzz"), (63, "twice near zed@q.io and near twice zed@q.io")]
    return rows + [(70 + k, " ".join(f"m{j}@list.net name{j}" for j in range(40))) for k in range(2)]


@pytest.mark.parametrize("which", ["crowded", "edges", "sf"])
def test_added_spans_and_shares_brute_force(spark, sf, which):
    rows = {"crowded": crowded, "edges": lambda: TEXTS, "sf": lambda: texts(spark, sf)}[which]()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, tuple(sorted((x.start, x.end, x.value, round(x.share, 9)) for x in r.added))) for r in pii.spans(df).collect())
    want = disclosed(rows)
    assert got == want and (which == "edges" or any(places for _, places in want))


def test_two_places_in_one_document_count_once(spark):
    rows = [(0, f"twice zed@corp.example {prose(20, 1)} twice zed@corp.example")] + [(k, f"zed@corp.example {prose(20, k)}") for k in range(1, 9)] + [(k, f"twice {prose(20, k)}") for k in range(9, 12)]
    added = {r.doc_id: r.added for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(x.value == "twice" for places in added.values() for x in places)


def test_places_inside_spans_do_not_count(spark):
    """A word that stands beside one address still tells of it, though other documents hold the word inside an address."""
    rows = [(0, f"{prose(20, 1)} quartermaster zed@corp.example"), *[(k, prose(30, k)) for k in range(1, 60)]]
    more = [(100 + k, f"quartermaster@x{k}.org {prose(20, 100 + k)}") for k in range(8)]
    for some in (rows, rows + more):
        got = {r.doc_id: r.added for r in pii.spans(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert [x.value for x in got[0] if x.value == "quartermaster"] == ["quartermaster"]


def test_the_filler_letter_is_in_no_term(spark):
    rows = [(0, f"near{pii.FILLER} {pii.FILLER}far beside a@b.cd"), *[(k, f"beside{pii.FILLER} near far {prose(9, k)}") for k in range(1, 9)]]
    got = Counter((r.doc_id, tuple(sorted((x.start, x.end, x.value, round(x.share, 9)) for x in r.added))) for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == disclosed(rows)


def test_sanitise_edges(spark):
    rows = [*TEXTS, (1, "Call +44 20 7946 0958"), (1, "other a@b.cd"), (None, "x@y.zz 1.2.3.4"), (20, "p+4111111111111111@c.de")]
    df = frame(spark, rows)
    clean = pii.sanitise(df, length_col="n_chars")
    assert clean.columns == df.columns
    left = Counter((r.doc_id, r.text, r.n_chars) for r in clean.collect())
    for i, t in rows:
        if not base_spans(t or ""):
            assert left[i, t, None if t is None else len(t)]
    texts_left = {t for _, t, _ in left}
    assert {"<EMAIL> <IP>", "<EMAIL>"} <= texts_left and all(n == len(t) for _, t, n in left if t is not None)
    assert not any(base_spans(t or "") for t in texts_left)
