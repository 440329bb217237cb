"""Audits of stored results and losses rolled up from scored codons.

Receipts, offsets and candidate banks are held against what is really there by grouped counts and
equi joins, so no shard, bank or group is walked in order by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.sequence import codons, log_frame_loss, r6
from ..registry import query
from ..sources.views import CDS_SQL, CODONS_SQL, cds, positions, table
from .design import case_regions
from .language_models import _MODELS, argmax_chain, fit_bigram, fit_unigram
from .profiles import weighted_mean
from .sampling import _ANCHOR, anchors, pairs


def check_receipts(receipts: DataFrame, actual: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, state): ok, drift (another digest), missing (listed, not there) or unlisted."""
    want, have = receipts.select(name, F.col(digest).alias("want")), actual.select(name, F.col(digest).alias("have"))
    rows = want.join(have, name, "full")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") == F.col("want"), "ok")
    return rows.select(name, state.otherwise("drift").alias("state"))


@query(
    "A32_S19_receipt_rollup",
    """WITH actual AS (SELECT 'page-' || page_id AS name, sha256(coalesce(html, '')) AS digest FROM pages),
    receipts AS (SELECT CASE WHEN page_id % 101 = 0 THEN 'lost-' ELSE 'page-' END || page_id AS name, sha256(coalesce(html, '') || CASE WHEN page_id % 97 = 0 THEN '!' ELSE '' END) AS digest FROM pages)
    SELECT CASE WHEN a.digest IS NULL THEN 'missing' WHEN r.digest IS NULL THEN 'unlisted' WHEN a.digest = r.digest THEN 'ok' ELSE 'drift' END AS state, count(*) AS n, min(name) AS example
    FROM receipts r FULL JOIN actual a USING (name) GROUP BY 1""",
)
def a32(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts of all pages, some changed and some renamed, against the pages themselves."""
    pages, html = table(spark, sf, "pages"), F.coalesce("html", F.lit(""))
    actual = pages.select(F.concat(F.lit("page-"), "page_id").alias("name"), F.sha2(html, 256).alias("digest"))
    renamed = F.when(F.col("page_id") % 101 == 0, "lost-").otherwise("page-")
    changed = F.when(F.col("page_id") % 97 == 0, "!").otherwise("")
    receipts = pages.select(F.concat(renamed, "page_id").alias("name"), F.sha2(F.concat(html, changed), 256).alias("digest"))
    return check_receipts(receipts, actual, "name", "digest").groupBy("state").agg(F.count("*").alias("n"), F.min("name").alias("example"))


def offset_breaks(spans: DataFrame, group: str, start: str, length: str) -> DataFrame:
    """(group, n, total, starts_at_zero, n_short, n_breaks) of token spans that should lie end to end.

    Inside a store each boundary is one span's end and one span's start; this is counted by
    boundary, not by walking the spans. A span of one token or less is short."""
    s, n = F.col(start), F.col(length)
    ends = F.array(F.struct(s.alias("at"), F.lit(1).alias("opens"), F.lit(0).alias("closes")), F.struct((s + n).alias("at"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))
    at = spans.select(group, F.explode(ends).alias("e")).groupBy(group, "e.at").agg(F.sum("e.opens").alias("opens"), F.sum("e.closes").alias("closes"))
    per = spans.groupBy(group).agg(F.count("*").alias("n"), F.sum(n).alias("total"), (F.min(s) == 0).alias("starts_at_zero"), F.count_if(n <= 1).alias("n_short"))
    odd = at.where("opens <> 1 OR closes <> 1").join(per.select(group, "total"), group).where("at > 0 AND at < total").groupBy(group).agg(F.count("*").alias("n_breaks"))
    return per.join(odd, group, "left").withColumn("n_breaks", F.coalesce("n_breaks", F.lit(0)))


@query(
    "S15_offset_check",
    f"""WITH {CDS_SQL}, spans AS (SELECT taxon, length(rna) // 3 AS k, sum(length(rna) // 3) OVER (PARTITION BY taxon ORDER BY doc_id) - length(rna) // 3 + CASE WHEN doc_id % 89 = 0 THEN 1 ELSE 0 END AS s FROM cds),
    odd AS (SELECT taxon, edge FROM (SELECT taxon, s AS edge, 1 AS o, 0 AS c FROM spans UNION ALL SELECT taxon, s + k, 0, 1 FROM spans) GROUP BY ALL HAVING sum(o) <> 1 OR sum(c) <> 1),
    per AS (SELECT taxon, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, min(s) = 0 AS starts_at_zero, count(*) FILTER (k <= 1) AS n_short FROM spans GROUP BY 1)
    SELECT taxon, n, total, starts_at_zero, n_short, (SELECT count(*) FROM odd WHERE odd.taxon = per.taxon AND edge > 0 AND edge < total) AS n_breaks FROM per""",
)
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of every taxon's token store, some of them shifted by one."""
    records = cds(spark, sf).select("taxon", "doc_id", (F.length("rna") / 3).cast("long").alias("k"))
    spans = positions(records, ["taxon"], F.floor(F.col("doc_id") / 1000), ["doc_id"], F.col("k"))
    shifted = F.col("pos") + F.when(F.col("doc_id") % 89 == 0, 1).otherwise(0)
    return offset_breaks(spans.select("taxon", "k", shifted.alias("s")), "taxon", "s", "k")


def lenient_codons(text: Column) -> Column:
    """Triplets of a text read as RNA (T is U); those with another letter and a short tail are left out."""
    rna = F.translate(F.upper(text), "T", "U")
    return F.filter(F.regexp_extract_all(rna, F.lit(r"([\s\S]{3})"), F.lit(1)), lambda c: c.rlike("^[ACGU]{3}$"))


@query(
    "F4_lenient_split",
    """SELECT doc_id, len(c) AS n, sha256(array_to_string(c, ',')) AS codons_sha256 FROM (
      SELECT doc_id, list_filter(regexp_extract_all(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'T', 'U'), '[\\s\\S]{3}'), lambda x: regexp_matches(x, '^[ACGU]{3}$')) AS c FROM documents WHERE text IS NOT NULL)""",
)
def f4(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", lenient_codons(F.regexp_replace("text", "[^A-Za-z]", "")).alias("c"))
    return rows.select("doc_id", F.size("c").alias("n"), F.sha2(F.array_join("c", ","), 256).alias("codons_sha256"))


def first_error(truth: Column, prediction: Column) -> Column:
    """The place from 1 of the first codon that differs, over the codons both have; null if none does."""
    same = F.zip_with(truth, prediction, lambda a, b: a.isNull() | b.isNull() | (a == b))
    return F.nullif(F.array_position(same, F.lit(False)), F.lit(0))


@query(
    "W13_first_error",
    f"""WITH {CODONS_SQL}, model AS (SELECT family, arg_min(cs, doc_id) AS r FROM split GROUP BY 1)
    SELECT doc_id, nullif(coalesce(list_position(list_transform(list_zip(cs, r, true), lambda t: t[1] = t[2]), false), 0), 0) AS first_error FROM split JOIN model USING (family)""",
)
def w13(spark: SparkSession, sf: str) -> DataFrame:
    """Each record against the first one of its family."""
    records = cds(spark, sf).select("doc_id", "family", "rna")
    model = records.groupBy("family").agg(F.min_by("rna", "doc_id").alias("model"))
    rows = records.join(model, "family")
    return rows.select("doc_id", first_error(codons(F.col("rna")), codons(F.col("model"))).alias("first_error"))


def candidate_banks(cases: DataFrame, *identity: str) -> DataFrame:
    """(bank_key, n_cases, first_case, n_suffixes, guarded): cases that can share one bank of candidates.

    The key is a digest of the bank's identity; what follows the gap is no part of it. A bank is guarded if all its
    cases have one prefix, so that its candidates hold for each of them. The prefix is left context of a fixed size."""
    key = F.sha2(F.concat_ws("|", *identity), 256).alias("bank_key")
    return cases.select(key, "doc_id", "prefix", "suffix").groupBy("bank_key").agg(
        F.count("*").alias("n_cases"), F.min("doc_id").alias("first_case"), F.countDistinct("suffix").alias("n_suffixes"), (F.min("prefix") == F.max("prefix")).alias("guarded")
    )


@query(
    "L11_candidate_banks",
    f"""WITH {_ANCHOR}, c AS (SELECT doc_id, sequence_sha256, start, substr(rna, 3 * start - 11, 12) AS prefix, substr(rna, 3 * start + 13, 3 * n) AS suffix FROM cds JOIN anchor USING (doc_id) CROSS JOIN (VALUES (2), (6)) v(n))
    SELECT sha256(sequence_sha256 || '|' || start || '|4|4') AS bank_key, count(*) AS n_cases, min(doc_id) AS first_case, count(DISTINCT suffix) AS n_suffixes, min(prefix) = max(prefix) AS guarded FROM c GROUP BY 1""",
)
def l11(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of four codons at each record's anchor, after four and before two or six: the bank's identity is
    sequence, anchor, gap and left context, so both suffixes, and copies of a record, share it."""
    records = cds(spark, sf)
    found = case_regions(records, anchors(records, gap=4, left=4), 4, 4, 6, "sequence_sha256").withColumns({"gap": F.lit("4"), "left": F.lit("4")})
    cases = found.withColumn("suffix", F.explode(F.array(F.substring("suffix", 1, 6), F.col("suffix"))))
    return candidate_banks(cases, "sequence_sha256", "start", "gap", "left")


def scored(records: DataFrame, unigram: DataFrame, bigram: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, codon, logp, hit) of every codon after the first, teacher-forced. Models are 64 and
    4096 rows at most, so they are broadcast; an unseen predecessor falls back to the unigram."""
    rows = pairs(records, *keep).join(F.broadcast(unigram.withColumnRenamed("p", "u")), "codon")
    rows = rows.join(F.broadcast(bigram.withColumnRenamed("p", "b")), ["prev", "codon"], "left").join(F.broadcast(argmax_chain(bigram)), "prev", "left")
    return rows.select(*keep, "pos", "codon", F.log(F.coalesce("b", "u")).alias("logp"), F.coalesce(F.col("next") == F.col("codon"), F.lit(False)).alias("hit"))


def _scored_records(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    records = cds(spark, sf)
    train = records.where("cohort = 'training'")
    return scored(records, fit_unigram(train), fit_bigram(train), *keep)


_SCORED = f"""{_MODELS}, best AS (SELECT prev, codon AS next FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY p DESC, id) AS k FROM bi) WHERE k = 1),
scored AS (SELECT doc_id, family, cohort, pos, ln(coalesce(b.p, u.p)) AS logp, coalesce(best.next = body.codon, false) AS hit FROM body JOIN uni u USING (codon) LEFT JOIN bi b USING (prev, codon) LEFT JOIN best USING (prev))"""


@query("L13_continuation_logprob", f"WITH {_SCORED}, size AS (SELECT doc_id, length(rna) // 3 AS n FROM cds) SELECT doc_id, count(*) AS n, round(sum(logp), 4) AS logp FROM scored JOIN size s USING (doc_id) WHERE pos >= s.n // 2 GROUP BY doc_id")
def l13(spark: SparkSession, sf: str) -> DataFrame:
    """The second half of each record as the continuation of its first."""
    records = cds(spark, sf).withColumn("half", F.floor(F.floor(F.length("rna") / 3) / 2))
    train = records.where("cohort = 'training'")
    rows = scored(records, fit_unigram(train), fit_bigram(train), "doc_id", "half").where("pos >= half")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("logp"), 4).alias("logp"))


@query(
    "A34_training_diagnostics",
    f"""WITH {_SCORED} SELECT cohort, count(*) AS n, round(-avg(logp), 6) AS per_token, round(-sum(logp) / (3 * count(*) * ln(2)), 6) AS bits_per_base, round(count(*) FILTER (hit) / count(*), 6) AS accuracy
    FROM scored GROUP BY cohort""",
)
def a34(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    return _scored_records(spark, sf, "cohort").groupBy("cohort").agg(
        n.alias("n"), r6(-F.avg("logp")).alias("per_token"), r6(log_frame_loss(F.sum("logp"), 3 * n)).alias("bits_per_base"), r6(F.count_if("hit") / n).alias("accuracy")
    )


def family_macro(losses: DataFrame, family: str, loss: str, tokens: str) -> DataFrame:
    """(n_families, token_loss, family_macro): the loss a token over everything, and the mean over
    families of each one's own loss a token, so a large family weighs no more than a small one."""
    per = losses.groupBy(family).agg(F.sum(loss).alias("loss"), F.sum(tokens).alias("tokens"))
    return per.agg(F.count("*").alias("n_families"), r6(F.try_divide(F.sum("loss"), F.sum("tokens"))).alias("token_loss"), r6(F.avg(F.try_divide("loss", "tokens"))).alias("family_macro"))


@query(
    "N6_family_macro",
    f"""WITH {_SCORED} SELECT count(*) AS n_families, round(sum(l) / sum(t), 6) AS token_loss, round(avg(l / t), 6) AS family_macro FROM (SELECT family, -sum(logp) AS l, count(*) AS t FROM scored GROUP BY 1)""",
)
def n6(spark: SparkSession, sf: str) -> DataFrame:
    losses = _scored_records(spark, sf, "family").select("family", (-F.col("logp")).alias("loss"), F.lit(1).alias("tokens"))
    return family_macro(losses, "family", "loss", "tokens")


@query(
    "N3_evidence_weighted_loss",
    f"""WITH {_SCORED}, doc AS (SELECT doc_id, cohort, -avg(logp) AS loss FROM scored GROUP BY ALL),
    w AS (SELECT cohort, loss, CASE (doc_id % 4) + 1 WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.1 END::DOUBLE AS w FROM doc)
    SELECT cohort, count(*) AS n, round(sum(w * loss) / sum(w), 6) AS loss FROM w GROUP BY cohort""",
)
def n3(spark: SparkSession, sf: str) -> DataFrame:
    """Each record's loss a token, weighted by its evidence tier."""
    docs = _scored_records(spark, sf, "doc_id", "cohort").groupBy("doc_id", "cohort").agg((-F.avg("logp")).alias("loss"))
    weights = F.create_map(*[F.lit(x) for kv in codes.TIER_WEIGHTS.items() for x in kv])
    weight = F.element_at(weights, (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.groupBy("cohort").agg(F.count("*").alias("n"), r6(weighted_mean(F.col("loss"), weight)).alias("loss"))
