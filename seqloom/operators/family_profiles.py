"""Column profiles of families against one reference each, and gap cases described by them.

A family's reference is the record of the focus taxon with the smallest sequence hash, or of any taxon if the focus has
none. Records with as many codons as the reference count place by place; the others' proteins are aligned with the
reference's, and codons in its blocks count at the reference's places. Copies are aligned once and counted by their
number. The profile is one row for each (family, place, codon), so it is joined with cases by place, broadcast only behind
a count of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.affine import Scoring
from ..functions.codes import GC_SQL, VOCABULARY_SQL
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import cds, fragments, fragments_sql
from .alignment import aligned
from .design import case_regions
from .sampling import anchors

FOCUS = "src1"
GLOBAL = Scoring(match=1.0, mismatch=-1.0, open_gap=-2.0, extend_gap=-0.5)
#: Rows up to which a profile is broadcast (about 50 bytes each).
BROADCAST_ROWS = 200_000


def family_references(records: DataFrame, focus: str) -> DataFrame:
    """(family, reference, reference_table, reference_sha256): one record of each family."""
    first = F.struct((~F.col("taxon").eqNullSafe(F.lit(focus))).alias("other"), "sequence_sha256")
    best = records.groupBy("family").agg(F.min_by(F.struct("rna", "translation_table", "sequence_sha256"), first).alias("b"))
    return best.select("family", F.col("b.rna").alias("reference"), F.col("b.translation_table").alias("reference_table"), F.col("b.sequence_sha256").alias("reference_sha256"))


def column_counts(records: DataFrame, references: DataFrame, scoring: Scoring = GLOBAL) -> DataFrame:
    """(family, pos, codon, amino_acid, n): what stands at each of the reference's places (from 0). records: family, rna,
    translation_table, sequence_sha256.

    Defined results: null families are one; a null sequence counts nowhere; a place that no record reaches has no row; a
    codon opposite a gap of the reference counts nowhere; an empty table gives an empty result."""
    scratch = Scratch(records.sparkSession, "profile")
    key = F.coalesce(F.concat(F.lit("="), "family"), F.lit(""))
    known = references.select(key.alias("key"), "reference", "reference_table")
    # one row of each distinct sequence: only short keys are grouped, and a copy's letters are no more than the first's
    rows = records.where(F.col("rna").isNotNull()).groupBy(key.alias("key"), "translation_table", "sequence_sha256").agg(F.count("*").alias("n"), F.first("family").alias("family"), F.first("rna").alias("rna"))
    rows = scratch.write(rows, "distinct").join(known, "key")
    same = F.length("rna") == F.length("reference")
    protein = S.translate(F.when(~same, F.col("rna")), F.col("translation_table"))
    other = S.translate(F.when(~same, F.col("reference")), F.col("reference_table"))
    # aligned pairs are dealt out by sequence, as a family may hold most of them
    rows = rows.repartition("sequence_sha256").withColumns({"protein": protein, "other": other})
    found = rows.withColumn("m", aligned(F.col("protein"), F.col("other"), scoring)).withColumn("cs", S.codons(F.col("rna")))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.size("cs").alias("n")))
    blocks = F.when(F.col("m").isNull(), whole).otherwise(F.col("m.blocks"))

    def placed(block: Column) -> Column:
        return F.transform(F.slice(F.col("cs"), block["a"] + 1, block["n"]), lambda c, k: F.struct((block["b"] + k).alias("pos"), c.alias("codon")))

    columns = found.select("family", "translation_table", "n", F.explode(F.flatten(F.transform(blocks, placed))).alias("c")).select("family", "translation_table", "n", "c.*")
    counts = columns.groupBy("family", "translation_table", "pos", "codon").agg(F.sum("n").alias("n"))
    return counts.groupBy("family", "pos", "codon", S.amino_acid(F.col("codon"), F.col("translation_table")).alias("amino_acid")).agg(F.sum("n").alias("n"))


def describe_columns(counts: DataFrame) -> DataFrame:
    """(family, pos, total, most, codon_entropy, aa_entropy, codon_conservation, aa_conservation, consensus_codon,
    consensus_aa). Conservation is one less the entropy's share of that of 64 codons or 20 amino acids, within 0 and 1; of
    equally frequent codons the first in the vocabulary's order is the consensus, of amino acids the first letter."""

    def summary(rows: DataFrame, item: str, rank: Column, classes: int, names: tuple[str, str, str]) -> DataFrame:
        total, logs = F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("logs")
        best = F.max(F.struct("n", rank.alias("rank"), item)).alias("best")
        made = rows.groupBy("family", "pos").agg(total, logs, best)
        h = F.greatest(F.lit(0.0), F.log2("total") - F.col("logs") / F.col("total"))
        score = F.when(F.col("total") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / F.log2(F.lit(float(classes))))))
        return made.select("family", "pos", "total", F.col("best.n").alias("most"), S.r6(h).alias(names[0]), S.r6(score).alias(names[1]), F.col(f"best.{item}").alias(names[2]))

    codon = counts.groupBy("family", "pos", "codon").agg(F.sum("n").alias("n"))
    acid = counts.groupBy("family", "pos", "amino_acid").agg(F.sum("n").alias("n"))
    first = summary(codon, "codon", -S.codon_index(F.col("codon")), 64, ("codon_entropy", "codon_conservation", "consensus_codon"))
    second = summary(acid, "amino_acid", -F.ascii("amino_acid"), 20, ("aa_entropy", "aa_conservation", "consensus_aa")).drop("total", "most").withColumnsRenamed({"family": "f", "pos": "p"})
    return first.join(second, F.col("family").eqNullSafe(F.col("f")) & (F.col("pos") == F.col("p"))).drop("f", "p")


def describe_cases(cases: DataFrame, counts: DataFrame) -> DataFrame:
    """Each case (case_id, family, start, truth) against its family's profile: arrays with an entry for each codon of the
    truth, and means over those inside the profile.

    Outside it entropies, conservation and consensus are null, the codon's share is 0, it matches no consensus, and its
    label is unsupported_position; inside, unobserved_codon, observed_minority or majority. Without a place inside, mean
    entropy is 0 and mean conservation 1. case_id is unique; a null truth has no entries."""
    scratch = Scratch(counts.sparkSession, "cases")
    counts = scratch.write(counts, "counts")
    profile = scratch.write(describe_columns(counts), "profile")
    small = profile.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    seen = counts.groupBy("family", "pos", "codon").agg(F.sum("n").alias("n"))
    seen = seen.select(F.col("family").alias("f"), F.col("pos").alias("p"), F.col("codon").alias("c"), "n")
    at = cases.select("case_id", "family", F.posexplode_outer(S.codons(F.col("truth"))).alias("k", "codon"), "start").withColumn("pos", F.col("start") + F.col("k"))
    profile = profile.withColumnsRenamed({"family": "pf", "pos": "pp"})
    rows = at.join(F.broadcast(profile) if small else profile, F.col("family").eqNullSafe(F.col("pf")) & (F.col("pos") == F.col("pp")), "left")
    rows = rows.join(seen, F.col("family").eqNullSafe(F.col("f")) & (F.col("pos") == F.col("p")) & (F.col("codon") == F.col("c")), "left")
    outside = F.col("total").isNull()
    label = F.when(outside, "unsupported_position").when(F.col("n").isNull(), "unobserved_codon").when(F.col("n") < F.col("most"), "observed_minority").otherwise("majority")
    matches = F.coalesce(F.col("codon") == F.col("consensus_codon"), F.lit(False))
    share = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))
    entry = F.struct(
        "k", "codon_entropy", "aa_entropy", "codon_conservation", "aa_conservation", "consensus_codon", "consensus_aa",
        matches.alias("consensus_match"), S.r6(share).alias("allele_frequency"), label.alias("label"),
    )
    all_ = rows.groupBy("case_id").agg(F.first("family").alias("family"), F.first("start").alias("start"), F.sort_array(F.collect_list(F.when(F.col("codon").isNotNull(), entry))).alias("e"))
    names = ["codon_entropy", "aa_entropy", "codon_conservation", "aa_conservation", "consensus_codon", "consensus_aa", "consensus_match", "allele_frequency", "label"]
    arrays = [F.col(f"e.{name}").alias({"label": "labels", "consensus_match": "consensus_matches", "allele_frequency": "allele_frequencies", "codon_entropy": "codon_entropies", "aa_entropy": "aa_entropies"}.get(name, f"{name}s")) for name in names]

    def mean(name: str, empty: float) -> Column:
        known = F.filter(F.col(f"e.{name}"), lambda x: x.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
        return S.r6(F.when(F.size(known) > 0, total / F.size(known)).otherwise(empty))

    rate = F.when(F.size("e") > 0, F.size(F.filter("e.consensus_match", lambda x: x)) / F.size("e")).otherwise(0.0)
    return all_.select("case_id", "family", "start", *arrays, mean("codon_entropy", 0.0).alias("mean_codon_entropy"), mean("codon_conservation", 1.0).alias("mean_codon_conservation"), S.r6(rate).alias("consensus_match_rate"))


def as_text(cases: DataFrame) -> DataFrame:
    """Arrays as comma-separated text: decimals of six places, `-` for null."""

    def text(column: str, kind: str) -> Column:
        one = (lambda x: x.cast("decimal(12,6)").cast("string")) if "double" in kind else (lambda x: x.cast("string"))
        return F.array_join(F.transform(column, one), ",", "-").alias(column)

    return cases.select(*[text(f.name, f.dataType.simpleString()) if f.dataType.simpleString().startswith("array") else F.col(f.name) for f in cases.schema])


WIDTH, GAP = 48, 4


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of 16 codons; a family is a language and source, so that some codons are rare or unseen."""
    rows = fragments(spark, sf, WIDTH).withColumn("translation_table", F.when(F.col("family") == "en", 1).otherwise(2))
    return rows.withColumn("family", F.concat_ws("/", "family", "taxon"))


_STRATA = f"""{fragments_sql(WIDTH)}, {GC_SQL}, {VOCABULARY_SQL}, st AS (SELECT doc_id, cohort, sequence_sha256, rna, concat_ws('/', family, taxon) AS family, CASE WHEN family = 'en' THEN 1 ELSE 2 END AS translation_table FROM frag),
cc AS (SELECT family, translation_table, pos, codon, count(*) AS n FROM (SELECT family, translation_table, unnest(range({WIDTH // 3})) AS pos, unnest(regexp_extract_all(rna, '...')) AS codon FROM st WHERE cohort = 'training') GROUP BY ALL),
cnt AS (SELECT family, pos, codon, aa, n, id FROM cc JOIN gc USING (translation_table, codon) JOIN vocab USING (codon)),
acid AS (SELECT family, pos, aa, sum(n) AS n FROM cnt GROUP BY ALL),
ph AS (SELECT family, pos, sum(n) AS total, max(n) AS most, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, arg_min(codon, (-n, id)) AS consensus_codon FROM cnt GROUP BY ALL),
pa AS (SELECT family, pos, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS ha, arg_min(aa, (-n, aa)) AS consensus_aa FROM acid GROUP BY ALL),
prof AS (SELECT family, CAST(pos AS INTEGER) AS pos, CAST(total AS BIGINT) AS total, CAST(most AS BIGINT) AS most, round(greatest(0, h), 6) + 0.0 AS codon_entropy, round(greatest(0, ha), 6) + 0.0 AS aa_entropy,
  round(CASE WHEN total <= 1 THEN 1 ELSE greatest(0, least(1, 1 - greatest(0, h) / 6)) END, 6) + 0.0 AS codon_conservation, round(CASE WHEN total <= 1 THEN 1 ELSE greatest(0, least(1, 1 - greatest(0, ha) / log2(20))) END, 6) + 0.0 AS aa_conservation,
  consensus_codon, consensus_aa FROM ph JOIN pa USING (family, pos))"""


@query("A12_reference_profile", f"WITH {_STRATA} SELECT * FROM prof")
def a12_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Equally long records: the profile of the training cohort, place by place."""
    records = Scratch(spark, "fragments").write(_strata(spark, sf).where("cohort = 'training'"), "records")
    return describe_columns(column_counts(records, family_references(records, FOCUS)))


_START = f"CAST(('0x' || substr(sequence_sha256, 1, 4))::BIGINT % {WIDTH // 3} AS INTEGER)"


def _joined(name: str, value: str) -> str:
    return f"string_agg({value}, ',' ORDER BY k) AS {name}"


def _decimal(x: str) -> str:
    return f"coalesce(CAST(CAST({x} AS DECIMAL(12,6)) AS VARCHAR), '-')"


_CASES = f"""{_STRATA}, ca AS (SELECT DISTINCT sha256(family || ':' || sequence_sha256) AS case_id, family, rna, {_START} AS start FROM st WHERE cohort = 'holdout'),
ex AS (SELECT case_id, family, start, unnest(range({GAP})) AS k, regexp_extract_all(rna || rna[1:{3 * GAP}], '...') AS cs FROM ca),
r AS (SELECT e.case_id, e.family, e.start, e.k, e.start + e.k AS pos, e.cs[e.start + e.k + 1] AS codon, p.*, c.n FROM ex e LEFT JOIN (SELECT * EXCLUDE (family, pos), family AS pf, pos AS pp FROM prof) p ON pf = e.family AND pp = e.start + e.k
  LEFT JOIN (SELECT family AS cf, pos AS cp, codon AS cc, n FROM cnt) c ON cf = e.family AND cp = e.start + e.k AND cc = e.cs[e.start + e.k + 1])
SELECT case_id, family, start, {_joined("codon_entropies", _decimal("codon_entropy"))}, {_joined("aa_entropies", _decimal("aa_entropy"))}, {_joined("codon_conservations", _decimal("codon_conservation"))}, {_joined("aa_conservations", _decimal("aa_conservation"))},
  {_joined("consensus_codons", "coalesce(consensus_codon, '-')")}, {_joined("consensus_aas", "coalesce(consensus_aa, '-')")}, {_joined("consensus_matches", "CAST(coalesce(codon = consensus_codon, false) AS VARCHAR)")},
  {_joined("allele_frequencies", _decimal("round(coalesce(n / total, 0), 6)"))},
  {_joined("labels", "CASE WHEN total IS NULL THEN 'unsupported_position' WHEN n IS NULL THEN 'unobserved_codon' WHEN n < most THEN 'observed_minority' ELSE 'majority' END")},
  round(coalesce(avg(codon_entropy), 0), 6) + 0.0 AS mean_codon_entropy, round(coalesce(avg(codon_conservation), 1), 6) + 0.0 AS mean_codon_conservation,
  round(avg(CASE WHEN codon = consensus_codon THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS consensus_match_rate FROM r GROUP BY case_id, family, start"""


@query("A33_case_arrays", f"WITH {_CASES}")
def a33_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of four codons of each distinct holdout fragment, from a place by hash; they may run out of the profile, where the
    sequence goes on from its start."""
    records = Scratch(spark, "fragments").write(_strata(spark, sf), "records")
    known = records.where("cohort = 'training'")
    start = F.conv(F.substring("sequence_sha256", 1, 4), 16, 10).cast("int") % (WIDTH // 3)
    cases = records.where("cohort = 'holdout'").groupBy("family", "sequence_sha256").agg(F.first("rna").alias("rna"))
    truth = F.substring(F.concat("rna", F.substring("rna", 1, 3 * GAP)), 3 * start + 1, F.lit(3 * GAP))
    cases = cases.select(F.sha2(F.concat_ws(":", "family", "sequence_sha256"), 256).alias("case_id"), "family", start.alias("start"), truth.alias("truth"))
    return as_text(describe_cases(cases, column_counts(known, family_references(known, FOCUS))))


@query("A12_aligned_profile")
def a12_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Whole records of any length against their family's reference."""
    records = Scratch(spark, "records").write(cds(spark, sf), "records")
    return describe_columns(column_counts(records, family_references(records, FOCUS)))


@query("A33_aligned_cases")
def a33_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """The gap at each holdout record's anchor against the aligned profile of the training records."""
    records = Scratch(spark, "records").write(cds(spark, sf), "records")
    known, asked = records.where("cohort = 'training'"), records.where("cohort = 'holdout'")
    cases = case_regions(asked, anchors(asked, GAP, GAP), GAP, GAP, GAP, "family")
    return as_text(describe_cases(cases, column_counts(known, family_references(known, FOCUS))))
