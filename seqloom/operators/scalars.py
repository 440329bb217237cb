"""Queries over the scalar functions, each on every record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import sequence as S
from ..functions.codes import GC_SQL
from ..registry import query
from ..sources.views import CDS_SQL, CODONS_SQL, cds, codon_rows, table


@query("P1_normalize_name", "SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]', '', 'g') AS name FROM part")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.normalize_name(F.concat_ws("-", "p_name", "p_brand")).alias("name"))


@query(
    "P2_split_terms",
    """SELECT c_custkey, array_to_string(list_filter(list_transform(regexp_split_to_array(c_name || '; ' || c_mktsegment || ',,', '[;,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS terms
    FROM customer""",
)
def p2(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("c_name", F.lit("; "), "c_mktsegment", F.lit(",,"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(S.split_terms(text), "|").alias("terms"))


@query(
    "F1_F2_complements",
    f"WITH {CDS_SQL} SELECT doc_id, md5(translate(rna, 'U', 'T')) AS dna_md5, md5(reverse(translate(rna, 'AUCG', 'UAGC'))) AS revcomp_md5 FROM cds",
)
def f1(spark: SparkSession, sf: str) -> DataFrame:
    rna = F.col("rna")
    # a sequence of A, C and G alone has no U and counts as DNA, whose A becomes T
    as_rna = F.translate(S.reverse_complement(rna), "T", "U")
    return cds(spark, sf).select("doc_id", F.md5(S.to_dna(rna)).alias("dna_md5"), F.md5(as_rna).alias("revcomp_md5"))


@query(
    "F3_codon_split",
    f"WITH {CODONS_SQL} SELECT doc_id, count(*) AS n_codons, min(codon) AS least, max(codon) AS most FROM codon GROUP BY doc_id",
)
def f3(spark: SparkSession, sf: str) -> DataFrame:
    c = S.codons(F.col("rna"))
    return cds(spark, sf).select("doc_id", F.size(c).cast("long").alias("n_codons"), F.array_min(c).alias("least"), F.array_max(c).alias("most"))


@query(
    "F5_F8_translate_gap",
    f"""WITH {CODONS_SQL}, {GC_SQL}
    SELECT doc_id, md5(string_agg(aa, '' ORDER BY pos)) AS protein_md5, count(*) FILTER (aa = '*') AS n_stops FROM codon JOIN gc USING (translation_table, codon) GROUP BY doc_id""",
)
def f8(spark: SparkSession, sf: str) -> DataFrame:
    protein = S.translate(F.col("rna"), F.col("translation_table"))
    return cds(spark, sf).select("doc_id", protein.alias("p")).select("doc_id", F.md5("p").alias("protein_md5"), (F.length("p") - F.length(F.translate("p", "*", ""))).cast("long").alias("n_stops"))


@query(
    "F6_translate_cds",
    f"""WITH {CODONS_SQL}, {GC_SQL}, t AS (
      SELECT doc_id, string_agg(aa, '' ORDER BY pos) AS p, bool_or(is_start AND pos = 0) AS s, max_by(is_stop, pos) AS e FROM codon JOIN gc USING (translation_table, codon) GROUP BY doc_id
    ) SELECT doc_id, length(p) AS n, CASE WHEN s AND e AND position('*' IN p[2:-2]) = 0 THEN md5('M' || p[2:-2]) END AS protein_md5 FROM t""",
)
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).select("doc_id", (F.length("rna") / 3).cast("long").alias("n"), F.md5(S.translate_cds(F.col("rna"), F.col("translation_table"))).alias("protein_md5"))


@query(
    "F7_initiation_type",
    f"""WITH {CODONS_SQL}, {GC_SQL}
    SELECT doc_id, codon AS first_codon, CASE WHEN codon = 'AUG' THEN 'canonical' WHEN is_start THEN 'near_cognate' ELSE 'invalid' END AS initiation
    FROM codon JOIN gc USING (translation_table, codon) WHERE pos = 0""",
)
def f7(spark: SparkSession, sf: str) -> DataFrame:
    first = F.substring("rna", 1, 3)
    return cds(spark, sf).select("doc_id", first.alias("first_codon"), S.initiation_type(first, F.col("translation_table")).alias("initiation"))


@query("F9_digests", f"WITH {CDS_SQL} SELECT doc_id, sequence_sha256, md5(rna) AS sequence_md5, length(rna) AS n FROM cds")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).select("doc_id", "sequence_sha256", F.md5("rna").alias("sequence_md5"), F.length("rna").cast("long").alias("n"))


@query(
    "F10_canonical_digest",
    f"""WITH {CDS_SQL} SELECT doc_id, sha256('{{"family":"' || family || '","sequence_sha256":"' || sequence_sha256 || '","translation_table":' || translation_table || '}}') AS digest FROM cds""",
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.to_json(F.struct("family", "sequence_sha256", "translation_table"))
    return cds(spark, sf).select("doc_id", F.sha2(payload, 256).alias("digest"))


@query(
    "F15_encode_codons",
    f"""WITH {CODONS_SQL}, ids AS (
      SELECT doc_id, pos, 16 * (instr('AUCG', codon[1]) - 1) + 4 * (instr('AUCG', codon[2]) - 1) + instr('AUCG', codon[3]) - 1 AS id FROM codon
    ) SELECT doc_id, sum(id) AS id_sum, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)) AS ids_md5 FROM ids GROUP BY doc_id""",
)
def f15(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(S.codons(F.col("rna")), lambda c: S.codon_index(c))
    rows = cds(spark, sf).select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("F17_decode_roundtrip", f"WITH {CDS_SQL} SELECT doc_id, md5(rna) AS decoded_md5, true AS same FROM cds")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    """Codon ids back to bases: an id's letters are its digits to the base of four."""
    base = lambda k: F.substring(F.lit(codes.BASES), k.cast("int") + 1, F.lit(1))
    rows = cds(spark, sf).select("doc_id", "rna", F.transform(S.codons(F.col("rna")), lambda c: S.codon_index(c)).alias("ids"))
    text = F.array_join(F.transform("ids", lambda i: F.concat(base(F.floor(i / 16)), base(F.floor(i / 4) % 4), base(i % 4))), "")
    return rows.select("doc_id", F.md5(text).alias("decoded_md5"), (text == F.col("rna")).alias("same"))


DEGENERATE = {"N": "ACGU", "R": "AG", "Y": "CU"} | {b: b for b in "ACGU"}


def degenerate_expansion(pattern: F.Column) -> F.Column:
    """Sorted array of the codons that a pattern of three letters of DEGENERATE stands for; null for any other letter."""
    of = F.create_map(*[F.lit(x) for kv in DEGENERATE.items() for x in kv])
    at = lambda k: F.split(F.try_element_at(of, F.substring(pattern, k, 1)), "")
    return F.array_sort(F.flatten(F.transform(at(1), lambda x: F.flatten(F.transform(at(2), lambda y: F.transform(at(3), lambda z: F.concat(x, y, z)))))))


@query(
    "F18_degenerate_expansion",
    """WITH d(code, bases) AS (VALUES ('N', 'ACGU'), ('R', 'AG'), ('Y', 'CU'), ('A', 'A'), ('C', 'C'), ('G', 'G'), ('U', 'U')),
    b AS (SELECT code, unnest(string_split(bases, '')) AS base FROM d),
    x AS (SELECT x.code || y.code || z.code AS pattern, count(*) AS n, string_agg(x.base || y.base || z.base, ' ' ORDER BY x.base, y.base, z.base) AS expanded FROM b x, b y, b z GROUP BY x.code, y.code, z.code),
    s AS (SELECT pattern, count(*) AS seen FROM (SELECT unnest(regexp_extract_all(replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'T', 'U'), '[ACGUNRY]{3}')) AS pattern FROM documents) GROUP BY 1)
    SELECT pattern, seen, n, expanded FROM s JOIN x USING (pattern)""",
)
def f18(spark: SparkSession, sf: str) -> DataFrame:
    """The patterns that the letters of all texts spell, how often, and what they stand for."""
    letters = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "T", "U")
    rows = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(letters, F.lit("([ACGUNRY]{3})"), F.lit(1))).alias("pattern"))
    rows = rows.groupBy("pattern").agg(F.count("*").alias("seen")).withColumn("e", degenerate_expansion(F.col("pattern")))
    return rows.select("pattern", "seen", F.size("e").cast("long").alias("n"), F.array_join("e", " ").alias("expanded"))


@query(
    "F19_vocabulary",
    f"""WITH {CODONS_SQL}, b(i, x) AS (VALUES (0, 'A'), (1, 'U'), (2, 'C'), (3, 'G')), v AS (SELECT CAST(16 * p.i + 4 * q.i + r.i AS INTEGER) AS id, p.x || q.x || r.x AS codon FROM b p, b q, b r)
    SELECT id, v.codon, count(c.codon) AS n FROM v LEFT JOIN codon c ON c.codon = v.codon GROUP BY ALL""",
)
def f19(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary with what the records have of each token."""
    n = codon_rows(cds(spark, sf)).groupBy("codon").agg(F.count("*").alias("n"))
    return codes.vocabulary(spark).join(n, "codon", "left").select("id", "codon", F.coalesce("n", F.lit(0)).alias("n"))


def extended_window(rna: F.Column, tis: F.Column, cds_length: F.Column, flank: int = 30, upstream: int = 6, downstream: int = 4) -> F.Column:
    """Struct (kozak, extended, segments) of a transcript whose coding part starts at place `tis` (from 0).

    Flanks are `flank` bases long, filled with A beyond the transcript's ends. Segments are a digit a base:
    0 before the coding part, 1 in the Kozak window, 2 coding, 3 after it."""
    before = F.lpad(F.right(F.left(rna, tis), F.lit(flank)), flank, "A")
    after = F.rpad(F.substring(rna, tis + cds_length + 1, F.lit(flank)), flank, "A")
    coding = F.substring(rna, tis + 1, cds_length)
    started = F.least(F.lit(downstream), cds_length)
    segments = F.concat(F.lit("0" * (flank - upstream) + "1" * upstream), F.repeat(F.lit("1"), started), F.repeat(F.lit("2"), cds_length - started), F.lit("3" * flank))
    kozak = F.rpad(F.concat(F.right(before, F.lit(upstream)), F.substring(rna, tis + 1, F.lit(downstream))), upstream + downstream, "A")
    return F.struct(kozak.alias("kozak"), F.concat(before, coding, after).alias("extended"), segments.alias("segments"))


def downsample(track: F.Column) -> F.Column:
    """The first of every three digits; an incomplete end is left out."""
    return F.regexp_replace(F.substring(track, F.lit(1), F.length(track) - F.length(track) % 3), "(.)..", "$1")


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, tis, kozak, extended, segments): the coding part of a record runs from its first AUG (or base, without one)
    to 30 bases before its end, or to the end of a record too short for that."""
    tis = F.greatest(F.instr("rna", "AUG") - 1, F.lit(0))
    rows = cds(spark, sf).select("doc_id", "rna", tis.alias("tis"))
    rest = F.length("rna") - F.col("tis")
    whole = F.expr("3 * int((length(rna) - tis - if(length(rna) - tis >= 33, 30, 0)) div 3)")
    return rows.where(rest >= 3).withColumn("size", whole).select("doc_id", "tis", extended_window(F.col("rna"), F.col("tis"), F.col("size")).alias("w")).select("doc_id", "tis", "w.*")


_WINDOW_SQL = f"""{CDS_SQL}, t AS (SELECT doc_id, rna, greatest(instr(rna, 'AUG') - 1, 0) AS tis FROM cds),
z AS (SELECT *, 3 * ((length(rna) - tis - CASE WHEN length(rna) - tis >= 33 THEN 30 ELSE 0 END) // 3) AS size FROM t),
w AS (SELECT doc_id, CAST(tis AS INTEGER) AS tis, rpad(lpad(substr(rna, greatest(tis - 6, 0) + 1, least(tis, 6)), 6, 'A') || substr(rna, tis + 1, 4), 10, 'A') AS kozak,
  lpad(substr(rna, greatest(tis - 30, 0) + 1, least(tis, 30)), 30, 'A') || substr(rna, tis + 1, size) || rpad(substr(rna, tis + size + 1, 30), 30, 'A') AS extended,
  repeat('0', 24) || repeat('1', 6 + least(4, size)) || repeat('2', size - least(4, size)) || repeat('3', 30) AS segments FROM z)"""


@query(
    "F20_extended_window",
    f"WITH {_WINDOW_SQL} SELECT doc_id, tis, kozak, length(extended) AS n, md5(extended) AS extended_md5, md5(segments) AS segments_md5 FROM w",
)
def f20(spark: SparkSession, sf: str) -> DataFrame:
    w = _windows(spark, sf)
    return w.select("doc_id", "tis", "kozak", F.length("extended").cast("long").alias("n"), F.md5("extended").alias("extended_md5"), F.md5("segments").alias("segments_md5"))


@query(
    "F21_initiation_weight",
    f"""WITH {CODONS_SQL}, w(codon, weight) AS (VALUES ('AUG', 1.0), ('CUG', 0.6), ('GUG', 0.5), ('UUG', 0.4), ('ACG', 0.3), ('AUU', 0.2))
    SELECT doc_id, CAST(coalesce(weight, 0) AS DOUBLE) AS weight FROM codon LEFT JOIN w USING (codon) WHERE pos = 0""",
)
def f21(spark: SparkSession, sf: str) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for kv in codes.INITIATION.items() for x in kv])
    return cds(spark, sf).select("doc_id", F.coalesce(F.try_element_at(weights, F.substring("rna", 1, 3)), F.lit(0.0)).alias("weight"))


@query(
    "F22_frame_offsets",
    f"""WITH {CDS_SQL}, t AS (SELECT doc_id, rna, instr(rna, 'AUG') - 1 AS tis FROM cds), p AS (SELECT doc_id, tis, unnest(range(length(rna))) AS i FROM t WHERE tis >= 0)
    SELECT doc_id, CASE WHEN i < tis THEN -1 ELSE (i - tis) % 3 END AS frame, count(*) AS n FROM p GROUP BY ALL""",
)
def f22(spark: SparkSession, sf: str) -> DataFrame:
    """Places before the first AUG have frame -1, those after it 0, 1, 2 in turn. Counted, not exploded."""
    rows = cds(spark, sf).select("doc_id", F.length("rna").alias("n"), (F.instr("rna", "AUG") - 1).alias("tis")).where("tis >= 0")
    share = lambda k: F.floor((F.col("n") - F.col("tis") + 2 - k) / 3).cast("long")
    counts = [F.struct(F.lit(-1).cast("long").alias("frame"), F.col("tis").cast("long").alias("n"))]
    counts += [F.struct(F.lit(k).cast("long").alias("frame"), share(k).alias("n")) for k in range(3)]
    return rows.select("doc_id", F.inline(F.array(*counts))).where("n > 0")


@query(
    "F25_shifted_targets",
    f"""WITH {CODONS_SQL} SELECT codon AS input, target, count(*) AS n FROM (SELECT codon, lead(codon, 1, 'END') OVER (PARTITION BY doc_id ORDER BY pos) AS target FROM codon) GROUP BY ALL""",
)
def f25(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a codon and the one to predict, without a window: the codon array against itself moved by one."""
    c = S.codons(F.col("rna"))
    pairs = F.arrays_zip(c.alias("input"), F.concat(F.slice(c, F.lit(2), F.size(c)), F.array(F.lit("END"))).alias("target"))
    rows = cds(spark, sf).select(F.inline(pairs).alias("input", "target"))
    return rows.groupBy("input", "target").agg(F.count("*").alias("n"))


@query(
    "F26_reconstruction_metrics",
    f"""WITH {CODONS_SQL}, {GC_SQL}, x AS (
      SELECT doc_id, translation_table, pos, codon AS truth, lag(codon, 1, 'AUG') OVER (PARTITION BY doc_id ORDER BY pos) AS predicted FROM codon
    ) SELECT doc_id, bool_and(truth = predicted) AS exact_span, count(*) FILTER (truth = predicted) AS codons_correct, count(*) FILTER (g.aa = h.aa) AS aas_correct,
      count(*) FILTER (g.aa = h.aa AND truth <> predicted) AS synonymous_errors, count(*) FILTER (h.aa = '*' AND g.aa <> '*') AS premature_stops,
      min(CASE WHEN truth <> predicted THEN pos + 1 END) AS first_error
    FROM x JOIN gc g ON g.translation_table = x.translation_table AND g.codon = truth JOIN gc h ON h.translation_table = x.translation_table AND h.codon = predicted GROUP BY doc_id""",
)
def f26(spark: SparkSession, sf: str) -> DataFrame:
    """The prediction repeats the codon before; the first one is AUG."""
    c = S.codons(F.col("rna"))
    rows = cds(spark, sf).select("doc_id", "translation_table", c.alias("truth"), F.concat(F.array(F.lit("AUG")), F.slice(c, F.lit(1), F.size(c) - 1)).alias("predicted"))
    return reconstruction(rows, "truth", "predicted", "translation_table").drop("translation_table")


def reconstruction(df: DataFrame, truth: str, predicted: str, table_col: str) -> DataFrame:
    """How a predicted codon array meets the true one of equal length; the two columns become metrics."""
    code = F.element_at(F.array(*[F.lit(codes.amino_acids(t)) for t in codes.TABLES]), F.col(table_col))
    aa = lambda c: F.substring("__code", S.codon_index(c, codes.CODE_ORDER) + 1, F.lit(1))
    keep = [c for c in df.columns if c not in (truth, predicted)]
    kinds = F.zip_with(
        truth,
        predicted,
        lambda t, p: F.when(t == p, 0).when(aa(t) == aa(p), 1).when((aa(p) == "*") & (aa(t) != "*"), 2).otherwise(3),
    )
    rows = df.withColumn("__code", code).select(*keep, kinds.alias("__kinds"))
    n = lambda *k: F.size(F.filter("__kinds", lambda x: x.isin(*k))).cast("long")
    wrong = F.transform("__kinds", lambda x: (x > 0).cast("int"))
    return rows.select(
        *keep,
        (n(0) == F.size("__kinds")).alias("exact_span"),
        n(0).alias("codons_correct"),
        n(0, 1).alias("aas_correct"),
        n(1).alias("synonymous_errors"),
        n(2).alias("premature_stops"),
        F.nullif(F.array_position(wrong, 1).cast("int"), F.lit(0)).alias("first_error"),
    )


@query(
    "F27_domain_features",
    f"""WITH {CDS_SQL}, d AS (SELECT doc_id, length(rna) // 3 AS n, doc_id % 7 AS gap_start, 4 AS gap FROM cds), e AS (SELECT *, n // 4 AS lo, n // 2 AS hi FROM d WHERE n >= 16)
    SELECT doc_id, CASE WHEN gap_start >= lo AND gap_start + gap <= hi THEN 'fully_inside_domain' WHEN gap_start + gap <= lo OR gap_start >= hi THEN 'outside_domain' ELSE 'straddles_boundary' END AS relation,
      abs(gap_start - lo) AS distance_to_start, abs(hi - gap_start - gap) AS distance_to_end, round(gap_start / n, 6) AS relative_position FROM e""",
)
def f27(spark: SparkSession, sf: str) -> DataFrame:
    d = cds(spark, sf).select("doc_id", F.floor(F.length("rna") / 3).alias("n"), (F.col("doc_id") % 7).alias("gap_start")).where("n >= 16")
    d = d.withColumns({"lo": F.floor(F.col("n") / 4), "hi": F.floor(F.col("n") / 2), "gap_end": F.col("gap_start") + 4})
    inside = (F.col("gap_start") >= F.col("lo")) & (F.col("gap_end") <= F.col("hi"))
    apart = (F.col("gap_end") <= F.col("lo")) | (F.col("gap_start") >= F.col("hi"))
    return d.select(
        "doc_id",
        F.when(inside, "fully_inside_domain").when(apart, "outside_domain").otherwise("straddles_boundary").alias("relation"),
        F.abs(F.col("gap_start") - F.col("lo")).alias("distance_to_start"),
        F.abs(F.col("hi") - F.col("gap_end")).alias("distance_to_end"),
        S.r6(F.col("gap_start") / F.col("n")).alias("relative_position"),
    )


@query(
    "F28_flanks",
    f"""WITH {CDS_SQL}, t AS (SELECT doc_id, rna, instr(rna, 'AUG') AS a FROM cds) SELECT doc_id, CASE WHEN a > 0 THEN substr(rna, greatest(1, a - 30), a - greatest(1, a - 30)) END AS flank5,
      CASE WHEN a > 0 THEN substr(rna, a + 3, 30) END AS flank3 FROM t""",
)
def f28(spark: SparkSession, sf: str) -> DataFrame:
    rows = cds(spark, sf).select("doc_id", "rna", F.instr("rna", "AUG").alias("a"))
    begin = F.greatest(F.lit(1), F.col("a") - 30)
    return rows.select("doc_id", F.when(F.col("a") > 0, F.substring("rna", begin, F.col("a") - begin)).alias("flank5"), F.when(F.col("a") > 0, F.substring("rna", F.col("a") + 3, F.lit(30))).alias("flank3"))


@query(
    "F30_learning_rate",
    """WITH r AS (SELECT batch, step, round(CASE WHEN step < 100 THEN 3e-4 * (step + 1) / 100 WHEN step < 2000 THEN 3e-4 * 0.5 * (1 + cos(pi() * (step - 100) / 1900)) ELSE 0 END, 9) AS rate
      FROM (SELECT l_orderkey AS batch, count(*) AS k, l_orderkey % 2100 AS step FROM lineitem GROUP BY l_orderkey)) SELECT batch, step, rate FROM r""",
)
def f30(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as batches of lines: the rate of the step that each is taken at."""
    batches = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch")).distinct().withColumn("step", F.col("batch") % 2100)
    return batches.withColumn("rate", learning_rate(F.col("step"), 2000, 100, 3e-4))


def learning_rate(step: F.Column, steps: int, warm_up: int, most: float) -> F.Column:
    """Linear warm-up, then a cosine to zero, and zero from the last step on."""
    cosine = 0.5 * (1 + F.cos(F.pi() * (step - warm_up) / (steps - warm_up)))
    return F.round(F.when(step < warm_up, most * (step + 1) / warm_up).when(step < steps, most * cosine).otherwise(0.0), 9)


@query(
    "F32_stable_accession",
    f"WITH {CDS_SQL} SELECT doc_id, regexp_replace(upper(trim(accession)), '\\.\\d+$', '') AS accession, regexp_replace(upper(trim(parent_accession)), '\\.\\d+$', '') AS parent FROM cds",
)
def f32(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).select("doc_id", S.stable_accession(F.col("accession")).alias("accession"), S.stable_accession(F.col("parent_accession")).alias("parent"))


@query(
    "F35_code_tables",
    f"""WITH {CODONS_SQL}, {codes.gc_sql(codes.TABLES)}, s AS (SELECT codon, count(*) AS seen FROM codon GROUP BY 1)
    SELECT CAST(translation_table AS INTEGER) AS translation_table, aa, count(*) AS n, string_agg(codon, ' ' ORDER BY codon) AS codons, count(*) FILTER (is_start) AS n_starts, CAST(sum(coalesce(seen, 0)) AS BIGINT) AS seen
    FROM gc LEFT JOIN s USING (codon) GROUP BY ALL""",
)
def f35(spark: SparkSession, sf: str) -> DataFrame:
    """Each table's amino acids with their codons, and what the records' codons would be under it."""
    seen = codon_rows(cds(spark, sf)).groupBy("codon").agg(F.count("*").alias("seen"))
    rows = codes.genetic_codes(spark).join(F.broadcast(seen), "codon", "left").groupBy("translation_table", "aa")
    return rows.agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("codon")), " ").alias("codons"), F.count_if("is_start").alias("n_starts"), F.sum(F.coalesce("seen", F.lit(0))).alias("seen")
    )


@query(
    "F36_number_format",
    "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'n/a' ELSE format('{:,.2f}', c_acctbal) END AS balance FROM customer",
)
def f36(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.format_number("c_acctbal", 2), F.lit("n/a")).alias("balance"))


@query("F37_utc_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def f37(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query(
    "F23_codon_tracks",
    f"""WITH {_WINDOW_SQL}, i AS (SELECT doc_id, segments, unnest(range(1, length(segments) - 1, 3)) AS i FROM w), c AS (SELECT doc_id, i, segments[i] AS segment FROM i)
    SELECT doc_id, md5(string_agg(segment, '' ORDER BY i)) AS track_md5, count(*) AS n, count(*) FILTER (segment = '1') AS n_kozak, count(*) FILTER (segment = '2') AS n_coding FROM c GROUP BY doc_id""",
)
def f23(spark: SparkSession, sf: str) -> DataFrame:
    """Segment of every codon of the whole window, taken from its first base."""
    rows = _windows(spark, sf).select("doc_id", downsample(F.col("segments")).alias("track"))
    count = lambda segment: F.length(F.regexp_replace("track", f"[^{segment}]", "")).cast("long")
    return rows.select("doc_id", F.md5("track").alias("track_md5"), F.length("track").cast("long").alias("n"), count(1).alias("n_kozak"), count(2).alias("n_coding"))


@query(
    "F33_control_tokens",
    f"WITH {CDS_SQL} SELECT family, count(*) AS n, count(*) FILTER (family IN ('en', 'de')) AS n_control FROM cds GROUP BY family",
)
def f33(spark: SparkSession, sf: str) -> DataFrame:
    control = F.array_contains(F.array(F.lit("en"), F.lit("de")), F.col("family"))
    return cds(spark, sf).groupBy("family").agg(F.count("*").alias("n"), F.count_if(control).alias("n_control"))


@query(
    "F34_prior_vector",
    f"""WITH {CDS_SQL}, b(i, x) AS (VALUES (0, 'A'), (1, 'U'), (2, 'C'), (3, 'G')), v AS (SELECT CAST(16 * p.i + 4 * q.i + r.i AS INTEGER) AS id, p.x || q.x || r.x AS codon FROM b p, b q, b r)
    SELECT id, codon, CAST(CASE codon WHEN 'AUG' THEN 1.0 WHEN 'CUG' THEN 0.6 WHEN 'GUG' THEN 0.5 WHEN 'UUG' THEN 0.4 WHEN 'ACG' THEN 0.3 WHEN 'AUU' THEN 0.2 ELSE 0 END AS DOUBLE) AS weight, count(rna) AS n_first
    FROM v LEFT JOIN cds ON rna[1:3] = codon GROUP BY id, codon""",
)
def f34(spark: SparkSession, sf: str) -> DataFrame:
    """The prior of every codon as a start, with the records that begin with it."""
    prior = spark.createDataFrame(list(codes.INITIATION.items()), "codon string, weight double")
    first = cds(spark, sf).groupBy(F.substring("rna", 1, 3).alias("codon")).agg(F.count("*").alias("n_first"))
    rows = codes.vocabulary(spark).join(F.broadcast(prior), "codon", "left").join(first, "codon", "left")
    return rows.select("id", "codon", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("n_first", F.lit(0)).alias("n_first"))


@query(
    "A1_codon_counts",
    f"WITH {CODONS_SQL} SELECT family, codon, count(*) AS n FROM codon GROUP BY ALL",
)
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return codon_rows(cds(spark, sf), "family").groupBy("family", "codon").agg(F.count("*").alias("n"))
