"""Bracket tokens, the infill transform and paired windows against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.functions import codes
from seqloom.operators import intervals, model_inputs

VOCABULARY = {3: [*model_inputs.CONTROLS, *codes.CODONS], 1: [*model_inputs.CONTROLS, *codes.BASES]}


def encoded(text, width, frame):
    if text is None:
        return None, "no_text"
    if frame not in (0, 1, 2):
        return None, "unknown_frame"
    tokens = [f"[FRAME_{frame}]", "[BOS]"]
    for part in re.split(r"(\[[A-Z0-9_]+\])", text):
        if re.fullmatch(r"\[[A-Z0-9_]+\]", part):
            tokens.append(part)
        elif len(part) % width:
            return None, "incomplete_stretch"
        else:
            part = part.replace("T", "U")
            tokens += [part[k : k + width] for k in range(0, len(part), width)]
    known = VOCABULARY[width]
    return [known.index(t) if t in known else 1 for t in [*tokens, "[EOS]"]], None


@pytest.mark.parametrize("width", [1, 3])
def test_bracket_tokens(spark, width):
    r = random.Random(width)
    texts = ["", None, "[MASK]", "[", "]", "[]", "[mask]", "AU[G", "AUG[GC]AUC", "[[PAD]]AA", "AUG\nAU", "ATGATT[EOS][EOS]", "NNNRYN", "é[UNK]éé", "A" * 30_000, "[FRAME_1]AUG[X_9]"]
    texts += ["".join(r.choice(["AUG", "GC", "T", "[PAD]", "[Q1]", "[", "]", "N"]) for _ in range(r.randint(1, 9))) for _ in range(80)]
    rows = [(k, t, k % 4 if k % 9 else None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, t string, f int")
    got = df.select("k", model_inputs.encode(F.col("t"), width, F.col("f"), True, True).alias("e")).select("k", "e.*").collect()
    assert [(x.ids, x.problem) for x in sorted(got, key=lambda x: x.k)] == [encoded(t, width, f) for _, t, f in rows]
    plain = df.where("t IS NOT NULL").select(model_inputs.encode(F.col("t"), width)["ids"].alias("i")).where("i IS NOT NULL")
    again = plain.select("i", model_inputs.encode(model_inputs.decode(F.col("i"), width), width)["ids"].alias("j"))
    assert all(x.i == x.j for x in again.collect()) and plain.count() > 20


def test_infill(spark):
    rows = [(k, list(range(10, 10 + n))) for k, n in enumerate([0, 1, 4, 5, 5, 5, *range(6, 60)])] + [(100, None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>").withColumn("seed", F.sha2(F.col("k").cast("string"), 256))
    forms = set()
    for x in df.select("k", "ids", model_inputs.infill(F.col("ids"), F.col("seed"), 80).alias("m")).collect():
        if x.ids is None:
            assert x.m is None
            continue
        h, n = [int(hashlib.sha256(str(x.k).encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)], len(x.ids)
        forms.add(x.m.form)
        if n <= 4 or h[0] % 100 >= 80:
            assert (x.m.form, x.m.first, x.m.ids, x.m.targets) == ("plain", None, x.ids, [-100] * n)
            continue
        a = 1 + h[1] % (n - 3)
        b = a + 1 + h[2] % max(n - 2 - a, 1)
        assert 1 <= a < b < n and (x.m.first, x.m.second) == (a, b)
        p, m, s = x.ids[:a], x.ids[a:b], x.ids[b:]
        assert x.m.ids == (p + s + m if x.m.form == "psm" else s + p + m) and x.m.targets == [-100] * (n - len(m)) + m
        assert x.m.form == ("psm" if h[3] % 100 < 50 else "spm")
    assert forms == {"plain", "psm", "spm"}


def test_each_problem_of_a_window(spark):
    ok = [(1, 10, 0, "a", "s", None), (1, 11, 100, "z", "s", 90)]
    rows = [*ok, (1, 2012, 100, "a", "s", None), (1, 2013, 200, "z", "s", 0), (1, 4014, 150, "a", "s", None), (1, 4015, 300, "z", "s", 5), (1, 4016, 300, "a", "s", None), (1, 4017, 300, "z", "s", 5)]
    rows += [(1, 4018, 310, "z", "s", None), (1, 4019, 320, "a", "s", 5), (1, 4020, 330, "a", "s", None), (1, 4021, 340, "z", "t", 5), (1, 4022, 350, "a", None, None), (1, 4023, 360, "z", None, 14), (1, 4024, 400, "a", "s", None)]
    rows += [(1, 4025, 2000, "z", "s", 5), (1, 4026, 2000, "a", "s", None), (2, 1, 5, "a", "s", None), (2, 2, 9, "z", "s", 1), (None, 1, 5, "a", "s", None), (1, None, 5, "a", "s", None), (3, 1, 0, "a", "s", None), (3, 2, 9, "z", "s", None)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, us long, kind string, scenario string, idle_us long")
    bounds = spark.createDataFrame([(1, 0, 1000), (3, 0, 1000)], "user_id long, low long, high long")
    got = {(x.user_id, x.pair): x.problem for x in intervals.paired_windows(events, ["a"], ["z"], bounds, 2).collect()}
    want = [None, "invalid_residency", "not_after_previous", "not_positive", "wrong_kinds", "other_scenario", "residency_disagrees", "out_of_bounds", "unpaired"]
    assert got == {(1, k): w for k, w in enumerate(want)} | {(2, 0): "out_of_bounds", (3, 0): "invalid_residency"}
    assert intervals.paired_windows(events.limit(0), ["a"], ["z"], bounds).count() == 0
