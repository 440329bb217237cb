"""Stored candidate banks and stored case results: reuse by anti-join, guards that compare what is stored, metrics derived again.

A bank's key is a digest of its identity, which names all that its candidates depend on and nothing behind the gap. Banks lie
as Parquet in a folder; a run generates only what is not there yet and appends it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.codes import GC_SQL
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import cds
from .design import case_regions
from .language_models import _BEAM, CLASSES, beam, fit_bigram
from .sampling import anchor_sql, anchors, require

IDENTITY = ("plan", "model_id", "sequence_sha256", "start", "gap", "left_context")


def bank_key() -> F.Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in IDENTITY]), 256)


def candidates_digest(candidates: str = "candidates") -> F.Column:
    return F.sha2(F.array_join(candidates, ","), 256)


class BankStore:
    """Banks in a folder: (bank_key, identity, candidates, candidates_sha256)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def banks(self) -> DataFrame | None:
        """What is stored; None before the first banks."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.folder) if there else None

    def ensure(self, cases: DataFrame, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The banks of the cases (IDENTITY, prefix), with fresh: whether this run made it.

        propose gets (bank_key, identity, prefix) of the banks that are not stored and returns them with candidates (an
        array, best first); it sees no truth and no suffix. Raises if cases of one bank differ in their prefix, or if a stored
        bank's identity does not give its key or its candidates not their digest. No cases: no banks."""
        scratch = Scratch(self.spark, "banks")
        asked = cases.withColumn("bank_key", bank_key()).groupBy("bank_key", *IDENTITY).agg(F.min("prefix").alias("prefix"), (F.min("prefix") != F.max("prefix")).alias("mixed"))
        asked = scratch.write(asked, "asked")
        require([("cases of one bank have different prefixes", asked.where("mixed").limit(1).count() == 0)])
        asked, stored = asked.drop("mixed"), self.banks()
        if stored is not None:
            mine = scratch.write(stored.join(asked.select("bank_key"), "bank_key", "left_semi"), "stored")
            changed = (F.col("bank_key") != bank_key()) | ~F.col("candidates_sha256").eqNullSafe(candidates_digest())
            require([("a stored candidate bank has changed", mine.where(changed).limit(1).count() == 0)])
            asked = asked.join(mine.select("bank_key"), "bank_key", "left_anti")
        made = propose(asked).select("bank_key", *IDENTITY, "candidates").withColumn("candidates_sha256", candidates_digest())
        made = scratch.write(made, "made")
        if made.limit(1).count():
            made.write.mode("append").parquet(self.folder)
        fresh = made.withColumn("fresh", F.lit(True))
        out = fresh if stored is None else fresh.unionByName(mine.select(*made.columns).withColumn("fresh", F.lit(False)))
        return Scratch(self.spark, "ensured").write(out, "banks")


def beam_proposals(bigram: DataFrame, gap: int, width: int) -> Callable[[DataFrame], DataFrame]:
    """Proposals of a one-codon model: they depend on the prefix's last codon, so they are 64 rows at most and are broadcast.
    A prefix without a known last codon has none."""
    found = beam(bigram.select(F.col("prev").alias("start")).distinct(), bigram, gap, width)
    ordered = F.array_sort(F.collect_list(F.struct((-F.round("logp", 9)).alias("o"), "path")))
    table = found.groupBy("start").agg(F.transform(ordered, lambda x: x["path"]).alias("candidates")).withColumnRenamed("start", "last")

    def propose(asked: DataFrame) -> DataFrame:
        rows = asked.withColumn("last", F.right("prefix", F.lit(3))).join(F.broadcast(table), "last", "left").drop("last")
        return rows.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))

    return propose


def reconstruction(truth: F.Column, prediction: F.Column, table: F.Column) -> F.Column:
    """struct<exact, correct_codons, correct_acids>; nothing is right without a prediction."""
    pairs = F.zip_with(S.codons(truth), S.codons(F.coalesce(prediction, F.lit(""))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    count = lambda f: F.size(F.filter(pairs, lambda p: F.coalesce(f(p), F.lit(False))))
    return F.struct(
        F.coalesce(truth == prediction, F.lit(False)).alias("exact"), count(lambda p: p["a"] == p["b"]).alias("correct_codons"),
        count(lambda p: S.amino_acid(p["a"], table) == S.amino_acid(p["b"], table)).alias("correct_acids"),
    )


METRICS = ("exact", "correct_codons", "correct_acids")


def evaluate(cases: DataFrame, banks: DataFrame, bigram: DataFrame) -> DataFrame:
    """Results of cases (doc_id, IDENTITY, prefix, truth, suffix, translation_table): the candidate that scores best with the codon
    behind the gap, its metrics, and what the bank would have allowed. Without candidates the prediction is null."""
    cases = cases.withColumn("bank_key", bank_key()).join(banks.select("bank_key", "candidates", "candidates_sha256"), "bank_key")
    lp = bigram.select("prev", "codon", F.log("p").alias("lp"))
    each = cases.select("doc_id", "prefix", "truth", "suffix", "translation_table", F.explode_outer("candidates").alias("path"))
    each = each.withColumns({"c0": F.right("prefix", F.lit(3)), "c1": F.substring("path", 1, 3), "c2": F.substring("path", 4, 3), "right": F.substring("suffix", 1, 3)})
    for k, (a, b) in enumerate((("c0", "c1"), ("c1", "c2"), ("c2", "right"))):
        each = each.join(F.broadcast(lp.toDF(a, b, f"l{k}")), [a, b], "left")
    follows = F.when(F.col("right") == "", 0.0).otherwise(F.coalesce("l2", F.lit(-math.log(CLASSES))))
    metric = reconstruction(F.col("truth"), F.col("path"), F.col("translation_table"))
    each = each.select("doc_id", "path", metric.alias("m"), F.round(F.col("l0") + F.col("l1") + follows, 9).alias("score"))
    best = F.max(F.when(F.col("path").isNotNull(), F.struct("score", (-F.conv(F.translate("path", "ACGU", "0123"), 4, 10).cast("long")).alias("o"), "path")))
    found = each.groupBy("doc_id").agg(
        best["path"].alias("prediction"), F.bool_or("m.exact").alias("recalled"), F.max("m.correct_codons").alias("max_codons"), F.max("m.correct_acids").alias("max_acids"),
        F.count("path").alias("n_candidates"),
    )
    rows = cases.join(found, "doc_id").withColumn("m", reconstruction(F.col("truth"), F.col("prediction"), F.col("translation_table")))
    return rows.select("doc_id", *IDENTITY, "translation_table", "truth", "prediction", *[F.col(f"m.{c}").alias(c) for c in METRICS], "recalled", "max_codons", "max_acids", "n_candidates", "candidates_sha256")


def revalidate(results: DataFrame, plan: str) -> DataFrame:
    """results with problem: the first thing in which a stored result disagrees with its plan or with its own strings, else null."""
    size = 3 * F.col("gap")
    wrong = lambda c: ~F.coalesce((F.length(c) == size) & F.col(c).rlike("^[ACGU]+$"), F.lit(False))
    again = reconstruction(F.col("truth"), F.col("prediction"), F.col("translation_table"))
    differs = F.lit(False)
    for c in METRICS:
        differs |= ~F.col(c).eqNullSafe(again[c])
    problem = F.when(~F.col("plan").eqNullSafe(F.lit(plan)), "other_plan").when(wrong("truth") | (F.col("prediction").isNotNull() & wrong("prediction")), "invalid_sequence").when(differs, "metrics_disagree")
    return results.withColumn("problem", problem)


def require_results(results: DataFrame, plan: str) -> DataFrame:
    """results, or ValueError with the first problem of any."""
    bad = revalidate(results, plan).where("problem IS NOT NULL").agg(F.min("problem"), F.count("*")).first()
    require([(f"stored results: {bad[0]} ({bad[1]} rows)", bad[1] == 0)])
    return results


PLAN, MODEL, GAP, LEFT, WIDTH = "plan-1", "bigram", 2, 4, 8


def _cases(records: DataFrame) -> DataFrame:
    held = records.where("cohort = 'holdout'")
    found = case_regions(held, anchors(held, gap=GAP, left=LEFT), GAP, LEFT, 1, "sequence_sha256", "translation_table")
    return found.withColumns({"plan": F.lit(PLAN), "model_id": F.lit(MODEL), "gap": F.lit(GAP), "left_context": F.lit(LEFT)})


_BANKS = f"""{_BEAM}, {anchor_sql(gap=GAP, left=LEFT)}, ca AS (SELECT doc_id, translation_table, sha256('{PLAN}|{MODEL}|' || sequence_sha256 || '|' || start || '|{GAP}|{LEFT}') AS bank_key, rna[3 * start - 2:3 * start] AS c0, rna[3 * start + 1:3 * start + 6] AS truth,
  rna[3 * start + 7:3 * start + 9] AS c3 FROM cds JOIN anchor USING (doc_id) WHERE cohort = 'holdout'),
cand AS (SELECT start AS c0, string_agg(path, ',' ORDER BY round(logp, 9) DESC, path) AS text, count(*) AS n FROM b2 GROUP BY start)"""


def _store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A first run over the cases of even ids and a second one over all; the cases, the model, and the second run's banks."""
    records = Scratch(spark, "records").write(cds(spark, sf), "records")
    bigram = Scratch(spark, "model").write(fit_bigram(records.where("cohort = 'training'")), "bigram")
    cases = Scratch(spark, "cases").write(_cases(records), "cases")
    store = BankStore(spark, f"{Scratch(spark, 'store').root}/banks")
    store.ensure(cases.where("doc_id % 2 = 0"), beam_proposals(bigram, GAP, WIDTH))
    return cases, bigram, store.ensure(cases, beam_proposals(bigram, GAP, WIDTH))


@query(
    "L11_stored_banks",
    f"""WITH {_BANKS} SELECT bank_key, bool_and(doc_id % 2 <> 0) AS fresh, CAST(coalesce(any_value(n), 0) AS INTEGER) AS n_candidates, sha256(coalesce(any_value(text), '')) AS candidates_sha256
    FROM ca LEFT JOIN cand USING (c0) GROUP BY bank_key""",
)
def l11_stored(spark: SparkSession, sf: str) -> DataFrame:
    _, _, banks = _store(spark, sf)
    return banks.select("bank_key", "fresh", F.size("candidates").alias("n_candidates"), "candidates_sha256")


@query(
    "L12_stored_results",
    f"""WITH {_BANKS}, {GC_SQL}, p AS (SELECT c.*, path, round(logp + CASE WHEN c3 = '' THEN 0 ELSE coalesce(ln(b.p), ln(1 / 64)) END, 9) AS score FROM ca c LEFT JOIN b2 ON b2.start = c0 LEFT JOIN bi b ON b.prev = b2.last AND b.codon = c3),
    m AS (SELECT p.*, coalesce(path = truth, false) AS exact, coalesce(CAST(path[1:3] = truth[1:3] AS INTEGER) + CAST(path[4:6] = truth[4:6] AS INTEGER), 0) AS correct_codons,
        coalesce(CAST(g1.aa = h1.aa AS INTEGER) + CAST(g2.aa = h2.aa AS INTEGER), 0) AS correct_acids
      FROM p JOIN gc h1 ON h1.translation_table = p.translation_table AND h1.codon = truth[1:3] JOIN gc h2 ON h2.translation_table = p.translation_table AND h2.codon = truth[4:6]
      LEFT JOIN gc g1 ON g1.translation_table = p.translation_table AND g1.codon = path[1:3] LEFT JOIN gc g2 ON g2.translation_table = p.translation_table AND g2.codon = path[4:6]),
    r AS (SELECT doc_id, bool_or(exact) AS recalled, max(correct_codons) AS max_codons, max(correct_acids) AS max_acids FROM m GROUP BY doc_id),
    one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, path) = 1)
    SELECT doc_id, path AS prediction, exact, correct_codons + CASE WHEN doc_id % 65 = 0 THEN 1 ELSE 0 END AS correct_codons, correct_acids, recalled, max_codons, max_acids,
      CASE WHEN doc_id % 55 = 0 THEN 'other_plan' WHEN doc_id % 65 = 0 THEN 'metrics_disagree' END AS problem FROM one JOIN r USING (doc_id)""",
)
def l12_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Results of all cases, stored with some rows spoiled, and judged again from what is stored."""
    cases, bigram, banks = _store(spark, sf)
    results = evaluate(cases, banks, bigram)
    spoiled = results.withColumns({"plan": F.when(F.col("doc_id") % 55 == 0, "plan-0").otherwise(F.col("plan")), "correct_codons": F.col("correct_codons") + F.when(F.col("doc_id") % 65 == 0, 1).otherwise(0)})
    rows = revalidate(Scratch(spark, "results").write(spoiled, "stored"), PLAN)
    return rows.select("doc_id", "prediction", *METRICS, "recalled", "max_codons", "max_acids", "problem")
