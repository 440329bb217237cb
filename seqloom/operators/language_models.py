"""Categorical sequence models: fit by counting, score and generate by joins with small tables.

A model is a table of at most 64 x 64 codon probabilities (or one row a position and codon). Prior
mass is 2, shared by 64 codons. Ties go to the codon first in vocabulary order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.codes import VOCABULARY_SQL
from ..functions.sequence import codon_index, log_frame_loss, r6
from ..registry import query
from ..sources.views import CODONS_SQL, cds, codon_rows
from .design import case_regions
from .sampling import anchor_sql, anchors, pairs

PRIOR, CLASSES = 2.0, 64


def smoothed(n: F.Column, total: F.Column) -> F.Column:
    return (F.coalesce(n, F.lit(0)) + PRIOR / CLASSES) / (F.coalesce(total, F.lit(0)) + PRIOR)


def fit_unigram(records: DataFrame) -> DataFrame:
    """(codon, p) of all 64 codons; first codons don't count."""
    n = codon_rows(records).where("pos > 0").groupBy("codon").agg(F.count("*").alias("n"))
    rows = codes.vocabulary(records.sparkSession).join(n, "codon", "left")
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # 64 rows
    return rows.select("codon", smoothed(F.col("n"), total).alias("p"))


def fit_bigram(records: DataFrame) -> DataFrame:
    """(prev, codon, p) for every codon after a predecessor that was seen."""
    n = pairs(records).groupBy("prev", "codon").agg(F.count("*").alias("n"))
    every = n.select("prev").distinct().select("prev", F.explode(F.array(*map(F.lit, codes.CODONS))).alias("codon"))
    rows = every.join(n, ["prev", "codon"], "left")
    return rows.select("prev", "codon", smoothed(F.col("n"), F.sum("n").over(Window.partitionBy("prev"))).alias("p"))


def fit_position(records: DataFrame) -> DataFrame:
    """(pos, codon, p, total) of what was seen at a position."""
    n = codon_rows(records).where("pos > 0").groupBy("pos", "codon").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("pos"))
    return n.select("pos", "codon", smoothed(F.col("n"), total).alias("p"), total.alias("total"))


_MODELS = f"""{CODONS_SQL}, {VOCABULARY_SQL}, pair AS (SELECT doc_id, family, cohort, pos, codon, lag(codon) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM codon), body AS (SELECT * FROM pair WHERE prev IS NOT NULL),
train AS (SELECT * FROM body WHERE cohort = 'training'), uni AS (SELECT codon, (coalesce(n, 0) + 2 / 64) / (sum(n) OVER () + 2) AS p FROM vocab LEFT JOIN (SELECT codon, count(*) AS n FROM train GROUP BY 1) USING (codon)),
bi AS (SELECT prev, v.codon, v.id, (coalesce(n, 0) + 2 / 64) / (sum(n) OVER (PARTITION BY prev) + 2) AS p FROM (SELECT DISTINCT prev FROM train) CROSS JOIN vocab v LEFT JOIN (SELECT prev, codon, count(*) AS n FROM train GROUP BY ALL) USING (prev, codon)),
posn AS (SELECT pos, codon, count(*) AS n, sum(count(*)) OVER (PARTITION BY pos) AS total FROM train GROUP BY pos, codon)"""


def training(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).where("cohort = 'training'")


@query("L1_unigram_fit", f"WITH {_MODELS} SELECT codon, p FROM uni")
def l1(spark: SparkSession, sf: str) -> DataFrame:
    return fit_unigram(training(spark, sf))


@query("L1_bigram_fit", f"WITH {_MODELS} SELECT prev, codon, p FROM bi")
def l1b(spark: SparkSession, sf: str) -> DataFrame:
    return fit_bigram(training(spark, sf))


@query(
    "L2_fallback_chain",
    f"""WITH {_MODELS}, spot AS (SELECT pos, max(total) AS total FROM posn GROUP BY 1), h AS (SELECT pos, codon, count(*) AS k FROM body WHERE cohort = 'holdout' GROUP BY ALL)
    SELECT model, CAST(sum(k) AS BIGINT) AS n, round(-sum(k * ln(p)) / sum(k), 6) AS loss FROM (
      SELECT k, CASE WHEN spot.pos IS NULL THEN 'unigram' ELSE 'position' END AS model, CASE WHEN spot.pos IS NULL THEN u.p ELSE (coalesce(q.n, 0) + 2 / 64) / (spot.total + 2) END AS p
      FROM h LEFT JOIN spot USING (pos) LEFT JOIN posn q USING (pos, codon) JOIN uni u USING (codon)) GROUP BY model""",
)
def l2(spark: SparkSession, sf: str) -> DataFrame:
    """The position's distribution where there is one, else the pooled unigram; cases are counted first."""
    records = cds(spark, sf)
    train = records.where("cohort = 'training'")
    position, unigram = fit_position(train), fit_unigram(train).withColumnRenamed("p", "p_unigram")
    at = position.groupBy("pos").agg(F.max("total").alias("at_total"))
    cases = codon_rows(records.where("cohort = 'holdout'")).where("pos > 0").groupBy("pos", "codon").agg(F.count("*").alias("k"))
    rows = cases.join(at, "pos", "left").join(position.select("pos", "codon", "p"), ["pos", "codon"], "left").join(F.broadcast(unigram), "codon")
    unseen = (PRIOR / CLASSES) / (F.col("at_total") + PRIOR)
    p = F.when(F.col("at_total").isNull(), F.col("p_unigram")).otherwise(F.coalesce("p", unseen))
    model = F.when(F.col("at_total").isNull(), "unigram").otherwise("position")
    return rows.groupBy(model.alias("model")).agg(F.sum("k").alias("n"), F.round(-F.sum(F.col("k") * F.log(p)) / F.sum("k"), 6).alias("loss"))


@query(
    "L3_teacher_forced_score",
    f"""WITH {_MODELS} SELECT doc_id, count(*) AS n, round(-sum(ln(u.p)) / (3 * count(*) * ln(2)), 6) AS unigram_bits, round(-sum(ln(coalesce(b.p, u.p))) / (3 * count(*) * ln(2)), 6) AS bigram_bits
    FROM body JOIN uni u USING (codon) LEFT JOIN bi b USING (prev, codon) WHERE cohort = 'holdout' GROUP BY doc_id""",
)
def l3(spark: SparkSession, sf: str) -> DataFrame:
    records = cds(spark, sf)
    train = records.where("cohort = 'training'")
    return score(records.where("cohort = 'holdout'"), fit_unigram(train), fit_bigram(train))


def score(records: DataFrame, unigram: DataFrame, bigram: DataFrame) -> DataFrame:
    """(doc_id, n, unigram_bits, bigram_bits): bits a base of each record. Models are 64 and 4096 rows
    at most, so they are broadcast; an unseen predecessor falls back to the unigram."""
    # a long record has at most 4096 different pairs: they are counted before the models come to them
    rows = pairs(records, "doc_id").groupBy("doc_id", "prev", "codon").agg(F.count("*").alias("k"))
    rows = rows.join(F.broadcast(unigram.withColumnRenamed("p", "u")), "codon").join(F.broadcast(bigram.withColumnRenamed("p", "b")), ["prev", "codon"], "left")
    k = F.col("k")
    sums = rows.groupBy("doc_id").agg(F.sum("k").alias("n"), F.sum(k * F.log("u")).alias("lu"), F.sum(k * F.log(F.coalesce("b", "u"))).alias("lb"))
    bits = lambda c: F.round(log_frame_loss(F.col(c), 3 * F.col("n")), 6)
    return sums.select("doc_id", "n", bits("lu").alias("unigram_bits"), bits("lb").alias("bigram_bits"))


def argmax_chain(bigram: DataFrame) -> DataFrame:
    """(prev, next): each predecessor's likeliest codon."""
    best = F.max(F.struct("p", (-codon_index(F.col("codon"))).alias("order"), "codon"))
    return bigram.groupBy("prev").agg(best.alias("b")).select("prev", F.col("b.codon").alias("next"))


def greedy(starts: DataFrame, bigram: DataFrame, steps: int) -> DataFrame:
    """(start, generated): codons that follow one another as the likeliest; `steps` joins with 64 rows."""
    chain = argmax_chain(bigram)
    rows = starts.select("start", F.col("start").alias("prev"), F.lit("").alias("generated"))
    for _ in range(steps):
        rows = rows.join(F.broadcast(chain), "prev").select("start", F.col("next").alias("prev"), F.concat("generated", "next").alias("generated"))
    return rows.select("start", "generated")


@query(
    "L4_greedy_generation",
    f"""WITH RECURSIVE {_MODELS}, chain AS (SELECT prev, codon AS next FROM bi QUALIFY row_number() OVER (PARTITION BY prev ORDER BY p DESC, id) = 1),
    g AS (SELECT prev AS start, prev, '' AS generated, 0 AS k FROM chain UNION ALL SELECT start, next, generated || next, k + 1 FROM g JOIN chain USING (prev) WHERE k < 8) SELECT start, generated FROM g WHERE k = 8""",
)
def l4(spark: SparkSession, sf: str) -> DataFrame:
    bigram = fit_bigram(training(spark, sf))
    return greedy(bigram.select(F.col("prev").alias("start")).distinct(), bigram, 8)


@query(
    "L5_L6_resubstitution",
    f"""WITH {_MODELS}, top AS (SELECT codon FROM uni JOIN vocab USING (codon) ORDER BY p DESC, id LIMIT 1)
    SELECT family, count(*) AS n, round(-sum(ln(u.p)) / (3 * count(*) * ln(2)), 6) AS unigram_bits, round(-sum(ln(b.p)) / (3 * count(*) * ln(2)), 6) AS bigram_bits, count(*) FILTER (codon = (SELECT codon FROM top)) AS unigram_correct
    FROM train JOIN uni u USING (codon) JOIN bi b USING (prev, codon) GROUP BY family""",
)
def l5(spark: SparkSession, sf: str) -> DataFrame:
    train = training(spark, sf)
    unigram, bigram = fit_unigram(train), fit_bigram(train)
    counts = pairs(train, "family").groupBy("family", "prev", "codon").agg(F.count("*").alias("k"))
    top = F.broadcast(unigram.agg(F.max(F.struct("p", (-codon_index(F.col("codon"))).alias("o"), "codon")).alias("t")).select(F.col("t.codon").alias("top")))
    rows = counts.join(F.broadcast(unigram.withColumnRenamed("p", "u")), "codon").join(F.broadcast(bigram.withColumnRenamed("p", "b")), ["prev", "codon"]).join(top)
    bits = lambda c: F.round(-F.sum(F.col("k") * F.log(c)) / (3 * F.sum("k") * math.log(2)), 6)
    return rows.groupBy("family").agg(
        F.sum("k").alias("n"), bits("u").alias("unigram_bits"), bits("b").alias("bigram_bits"), F.sum(F.when(F.col("codon") == F.col("top"), F.col("k")).otherwise(0)).alias("unigram_correct")
    )


def beam(starts: DataFrame, bigram: DataFrame, steps: int, width: int) -> DataFrame:
    """(start, path, logp): the `width` best continuations after each step, ties by path. A start has
    64 times width rows at most before each cut."""
    step = F.broadcast(bigram.select("prev", "codon", F.log("p").alias("lp")))
    rows = starts.select("start", F.col("start").alias("prev"), F.lit("").alias("path"), F.lit(0.0).alias("logp"))
    best = Window.partitionBy("start").orderBy(F.desc(F.round("logp", 9)), "path")
    for _ in range(steps):
        rows = rows.join(step, "prev").select("start", F.col("codon").alias("prev"), F.concat("path", "codon").alias("path"), (F.col("logp") + F.col("lp")).alias("logp"))
        rows = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= width).drop("place")
    return rows.select("start", "path", "logp")


_BEAM = f"""{_MODELS}, b1 AS (SELECT prev AS start, codon AS last, codon AS path, ln(p) AS logp FROM bi QUALIFY row_number() OVER (PARTITION BY prev ORDER BY round(ln(p), 9) DESC, codon) <= 8),
b2 AS (SELECT start, b.codon AS last, path || b.codon AS path, logp + ln(p) AS logp FROM b1 JOIN bi b ON b.prev = last QUALIFY row_number() OVER (PARTITION BY start ORDER BY round(logp + ln(p), 9) DESC, path || b.codon) <= 8)"""


@query("L7_W14_beam", f"WITH {_BEAM} SELECT start, path, round(logp, 6) AS logp FROM b2")
def l7(spark: SparkSession, sf: str) -> DataFrame:
    bigram = fit_bigram(training(spark, sf))
    found = beam(bigram.select(F.col("prev").alias("start")).distinct(), bigram, 2, 8)
    return found.select("start", "path", F.round("logp", 6).alias("logp"))


@query(
    "L8_joint_from_bases",
    f"""WITH {_MODELS}, b AS (SELECT codon[3] AS last FROM codon), t AS (SELECT unnest([codon[1] || codon[2], codon[2] || codon[3]]) AS t FROM codon), n AS (SELECT t[1] AS x, t[2] AS y, count(*) AS n FROM t GROUP BY ALL),
    p AS (SELECT x, y, n / sum(n) OVER (PARTITION BY x) AS p FROM n) SELECT a.x || a.y || c.y AS codon, round(a.p * c.p, 9) AS p FROM p a JOIN p c ON a.y = c.x""",
)
def l8(spark: SparkSession, sf: str) -> DataFrame:
    """Codon probabilities given their first base, from a base transition table of 16 rows."""
    n = codon_rows(cds(spark, sf)).groupBy("codon").agg(F.count("*").alias("n"))
    steps = n.select(F.explode(F.array(F.substring("codon", 1, 2), F.substring("codon", 2, 2))).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n"))
    x = F.substring("t", 1, 1)
    p = steps.select(x.alias("x"), F.substring("t", 2, 1).alias("y"), (F.col("n") / F.sum("n").over(Window.partitionBy(x))).alias("p"))
    a, c = p.toDF("x", "y", "p"), p.toDF("y", "z", "q")
    return a.join(F.broadcast(c), "y").select(F.concat("x", "y", "z").alias("codon"), F.round(F.col("p") * F.col("q"), 9).alias("p"))


@query(
    "L9_L10_rerank_and_recall",
    f"""WITH {_BEAM}, {anchor_sql(gap=2, left=4)}, h AS (SELECT doc_id, family, substr(rna, 3 * start - 2, 3) AS c0, substr(rna, 3 * start + 1, 3) AS c1, substr(rna, 3 * start + 4, 3) AS c2, substr(rna, 3 * start + 7, 3) AS c3 FROM cds JOIN anchor USING (doc_id) WHERE cohort = 'holdout'),
    c AS (SELECT doc_id, family, coalesce(path = c1 || c2, false) AS hit, coalesce(CAST(path[1:3] = c1 AS INTEGER) + CAST(path[4:6] = c2 AS INTEGER), 0) AS correct,
        row_number() OVER (PARTITION BY doc_id ORDER BY round(logp + CASE WHEN c3 = '' THEN 0 ELSE coalesce(ln(b.p), ln(1 / 64)) END, 9) DESC, path) AS place
      FROM h LEFT JOIN b2 ON start = c0 LEFT JOIN bi b ON b.prev = last AND b.codon = c3)
    SELECT family, count(DISTINCT doc_id) AS n, count(*) FILTER (hit) AS recalled, count(*) FILTER (hit AND place = 1) AS first_after_rerank, CAST(sum(best) AS BIGINT) AS correct_ceiling
    FROM (SELECT *, CASE WHEN place = 1 THEN max(correct) OVER (PARTITION BY doc_id) END AS best FROM c) GROUP BY family""",
)
def l9(spark: SparkSession, sf: str) -> DataFrame:
    """Beam candidates for a gap of two codons at each holdout record's anchor, ranked anew with what follows.

    The models look one codon back: of the left context the last codon decides, of the right one the first, and
    the codons beyond it add the same to every candidate's score. A case whose left codon was never seen before
    another has no candidate and recalls nothing; nothing follows a gap at a record's end. Each case has eight
    candidates at most."""
    records = cds(spark, sf)
    bigram = fit_bigram(records.where("cohort = 'training'"))
    bank = F.broadcast(beam(bigram.select(F.col("prev").alias("start")).distinct(), bigram, 2, 8).withColumnRenamed("start", "prefix"))
    holdout = records.where("cohort = 'holdout'")
    cases = case_regions(holdout, anchors(holdout, gap=2, left=4), 2, 1, 1, "family").select("doc_id", "family", "prefix", "truth", "suffix")
    right = F.broadcast(bigram.select(F.col("prev").alias("last"), F.col("codon").alias("suffix"), F.log("p").alias("lr")))
    rows = cases.join(bank, "prefix", "left").withColumn("last", F.right("path", F.lit(3))).join(right, ["last", "suffix"], "left")
    follows = F.when(F.col("suffix") == "", 0.0).otherwise(F.coalesce("lr", F.lit(-math.log(CLASSES))))
    same = lambda at: (F.substring("path", at, 3) == F.substring("truth", at, 3)).cast("int")
    rows = rows.withColumns({"hit": F.coalesce(F.col("path") == F.col("truth"), F.lit(False)), "correct": F.coalesce(same(1) + same(4), F.lit(0))})
    best = F.max(F.struct(F.round(F.col("logp") + follows, 9).alias("s"), (-F.conv(F.translate("path", "ACGU", "0123"), 4, 10).cast("long")).alias("o"), "hit"))
    each = rows.groupBy("doc_id", "family").agg(F.bool_or("hit").alias("any"), best.alias("b"), F.max("correct").alias("most"))
    return each.groupBy("family").agg(F.count("*").alias("n"), F.count_if("any").alias("recalled"), F.count_if(F.col("b.hit")).alias("first_after_rerank"), F.sum("most").alias("correct_ceiling"))


@query(
    "L12_case_evaluation",
    f"""WITH {_MODELS}, chain AS (SELECT prev, codon AS next FROM bi QUALIFY row_number() OVER (PARTITION BY prev ORDER BY p DESC, id) = 1)
    SELECT family, count(*) AS n, count(*) FILTER (codon = next) AS correct, round(count(*) FILTER (codon = next) / count(*), 6) AS accuracy FROM body JOIN chain USING (prev) WHERE cohort = 'holdout' GROUP BY family""",
)
def l12(spark: SparkSession, sf: str) -> DataFrame:
    records = cds(spark, sf)
    chain = F.broadcast(argmax_chain(fit_bigram(records.where("cohort = 'training'"))))
    rows = pairs(records.where("cohort = 'holdout'"), "family").join(chain, "prev").groupBy("family")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("codon") == F.col("next")).alias("correct"))
    return out.withColumn("accuracy", r6(F.col("correct") / F.col("n")))
