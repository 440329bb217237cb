"""Complete gates over submitted coding features: every reason in its order, for records and for features of a parent.

A record of the gates has columns: id, listed_id (that of the metadata), protein_id (the feature's), n_cds, taxa (of its
sources), qualifiers (names of those present), codon_start, location, dna, base_count and sequence_md5 (of the metadata,
the latter may be null), transl_table (text), translation, expected_taxon, expected_table, isoforms (reference proteins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locations
from ..functions import sequence as S
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import CDS_SQL, cds
from .alignment import PROTEINS, _best_isoform
from .gates import first_reason

#: Qualifiers that make a feature no plain coding sequence; fixed, in this order.
BARRED = ("pseudo", "pseudogene", "exception", "transl_except", "ribosomal_slippage", "artificial_location")


def record_rules(max_aa: int, with_metadata: bool = True) -> list[tuple[str, Column]]:
    """Rules that a record alone can break, in order. A null that a rule needs counts as broken."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    dna, table = F.upper("dna"), F.col("transl_table").try_cast("int")
    located = F.col("parts")
    exact = (F.size(located) > 0) & ~F.exists(located, lambda p: ~p["exact"])
    metadata = [
        ("length_metadata_mismatch", no(F.length("dna") == F.col("base_count"))),
        ("sequence_hash_mismatch", F.coalesce(F.col("sequence_md5") != F.md5(dna), F.lit(False))),
    ]
    return [
        ("not_one_cds", no(F.col("n_cds") == 1)),
        ("accession_mismatch", no((F.col("protein_id") == F.col("id")) & (F.col("listed_id") == F.col("id")))),
        ("wrong_taxon", no(F.array_distinct("taxa") == F.array("expected_taxon"))),
        *[(name, F.coalesce(F.array_contains("qualifiers", name), F.lit(False))) for name in BARRED],
        ("partial_frame", F.coalesce(F.col("codon_start"), F.lit("1")) != "1"),
        ("partial_location", no(exact)),
        ("ambiguous_bases", no(dna.rlike("^[ACGT]+$"))),
        ("incomplete_codon", F.length("dna") % 3 != 0),
        *(metadata if with_metadata else []),
        ("unexpected_genetic_code", no(table == F.col("expected_table"))),
        ("invalid_complete_cds", F.col("protein").isNull()),
        ("translation_mismatch", no(F.col("protein") == F.col("translation"))),
        ("not_microprotein", no(F.length("protein").between(1, max_aa))),
    ]


def _read(records: DataFrame) -> DataFrame:
    """Adds parts, rna and protein (null unless the sequence is a complete CDS)."""
    rna = F.translate(F.upper("dna"), "T", "U")
    table = F.coalesce(F.col("transl_table").try_cast("int"), F.lit(1))
    clean = F.when(F.upper("dna").rlike("^[ACGT]+$") & table.between(1, 33), rna)
    return records.withColumns({"parts": locations.parts(F.col("location")), "rna": rna, "protein": S.translate_cds(clean, table)})


def _result(rows: DataFrame, reason: Column) -> DataFrame:
    good = reason.isNull()
    return rows.withColumn("reason", reason).withColumn("sequence_sha256", F.when(good, F.sha2("rna", 256)))


def complete_cds_gate(records: DataFrame, least: float = 0.95, max_aa: int = 100) -> DataFrame:
    """(id, reason, identity, variant, sequence_sha256): the first rule that a record breaks, and of those that pass (reason
    null) how they differ from the isoform that aligns best.

    Records that break no rule of their own are aligned, each distinct (protein, isoform) once. Null isoforms are none; ids
    may repeat; an empty table gives an empty result."""
    scratch = Scratch(records.sparkSession, "cds-gate")
    isoforms = F.filter(F.coalesce("isoforms", F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    rows = _read(records).withColumn("isoforms", F.array_sort(F.array_distinct(isoforms)))
    own = first_reason([*record_rules(max_aa), ("no_reference_sequence", F.size("isoforms") == 0)])
    rows = scratch.write(rows.select("id", "rna", "protein", "isoforms", own.alias("own")), "own")
    asked = rows.where("own IS NULL").select("protein", "isoforms").distinct()
    pairs = asked.select("protein", "isoforms", F.explode("isoforms").alias("reference"))
    best = scratch.write(_best_isoform(pairs, ["protein", "isoforms"], "protein", "reference", PROTEINS), "best")
    rows = rows.join(best.select("protein", "isoforms", "identity", "variant"), ["protein", "isoforms"], "left")
    reason = F.coalesce("own", F.when(F.col("identity") < least, "reference_identity_below_threshold"))
    passed = F.col("reason").isNull()
    return _result(rows, reason).select("id", "reason", F.when(passed, S.r6("identity")).alias("identity"), F.when(passed, F.col("variant")).alias("variant"), "sequence_sha256")


def _secondary(rows: DataFrame, least: float, max_aa: int, with_metadata: bool) -> list[tuple[str, Column]]:
    reference = F.try_element_at("isoforms", F.lit(1))
    identity = 1 - S.hamming(F.col("protein"), reference) / F.length(reference)
    return [
        *record_rules(max_aa, with_metadata),
        ("no_reference_sequence", reference.isNull()),
        ("reference_length_mismatch", F.length("protein") != F.length(reference)),
        ("reference_identity_below_threshold", identity < least),
    ]


def secondary_gate(records: DataFrame, least: float = 0.95, max_aa: int = 100, with_metadata: bool = True) -> DataFrame:
    """(id, reason, identity, sequence_sha256): as complete_cds_gate, but against one equally long reference (the first
    isoform), place by place, so nothing is aligned and nothing moves."""
    rows = _read(records)
    reference = F.try_element_at("isoforms", F.lit(1))
    reason = first_reason(_secondary(rows, least, max_aa, with_metadata))
    identity = S.r6(1 - S.hamming(F.col("protein"), reference) / F.length(reference))
    return _result(rows, reason).select("id", "reason", F.when(F.col("reason").isNull(), identity).alias("identity"), "sequence_sha256")


def parent_gate(parents: DataFrame, names: list[str], least: float = 0.95, max_aa: int = 100) -> DataFrame:
    """(id, reason, accession, dna, identity, parts) of the coding feature with one of the names in each parent record.

    parents: id, listed_id, tax_id (of the metadata), reference_taxon, sequence, base_count, sequence_md5, taxa, features
    (an array of type, gene, product, protein_id, location, transl_table, translation, qualifiers, codon_start),
    expected_table, isoforms. The parent's own rules come first, then those of the one matching feature and its location,
    then those of secondary_gate() on the bases that the location gives. Names are compared by letters and digits only."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    wanted = F.array(*[S.normalize_name(F.lit(n)) for n in names])
    named = lambda f: (f["type"] == "CDS") & F.coalesce(F.array_contains(wanted, S.normalize_name(f["gene"])) | F.array_contains(wanted, S.normalize_name(f["product"])), F.lit(False))
    scratch = Scratch(parents.sparkSession, "parent-gate")
    # written, as the planner would repeat these expressions in every rule that looks at them
    rows = parents.withColumn("found", F.filter("features", named)).withColumn("feature", F.try_element_at("found", F.lit(1)))
    rows = scratch.write(rows.drop("features").withColumn("located", locations.parts(F.col("feature.location"))), "features")
    location, size = F.col("feature.location"), F.length("sequence")
    remote = F.coalesce(location.contains(":"), F.lit(True))
    kinds = locations.operators(location)
    inside = lambda p: F.coalesce((p["first"] >= 1) & (p["first"] <= p["last"]) & (p["last"] <= size), F.lit(False))
    own = [
        ("parent_accession_mismatch", no(F.col("id") == F.col("listed_id"))),
        ("parent_metadata_taxon_mismatch", no(F.col("tax_id") == F.col("reference_taxon"))),
        ("undefined_parent_sequence", F.coalesce(size, F.lit(0)) == 0),
        ("parent_length_mismatch", no(size == F.col("base_count"))),
        ("parent_hash_mismatch", F.coalesce(F.md5(F.upper("sequence")) != F.col("sequence_md5"), F.lit(False))),
        ("wrong_taxon", no(F.array_distinct("taxa") == F.array("reference_taxon"))),
        ("missing_annotated_cds", no(F.size("found") > 0)),
        ("multiple_annotated_cds", F.size("found") > 1),
        ("missing_protein_accession", F.coalesce(F.col("feature.protein_id"), F.lit("")) == ""),
        ("remote_or_missing_cds_location", remote),
        ("unsupported_location_operator", F.size(F.array_except(kinds, F.array(F.lit("join"), F.lit("complement")))) > 0),
        ("invalid_cds_location", F.col("located").isNull()),
        ("partial_location", F.exists("located", lambda p: ~p["exact"])),
        ("out_of_bounds_cds_location", F.exists("located", lambda p: ~inside(p))),
    ]
    rows = rows.withColumn("own", first_reason(own))
    dna = F.when(F.col("own").isNull(), locations.extract(F.col("sequence"), F.col("located")))
    derived = rows.select(
        "id", "own", "located", dna.alias("dna"), F.lit(1).alias("n_cds"), "feature.protein_id", "feature.location", F.col("feature.protein_id").alias("listed_id"), "taxa",
        "feature.qualifiers", "feature.codon_start", "feature.transl_table", "feature.translation", F.col("reference_taxon").alias("expected_taxon"), "expected_table", "isoforms",
    )
    read = scratch.write(_read(derived.withColumnRenamed("id", "parent").withColumn("id", F.col("protein_id"))), "derived")
    reference = F.try_element_at("isoforms", F.lit(1))
    reason = F.coalesce("own", first_reason(_secondary(read, least, max_aa, False)))
    identity = S.r6(1 - S.hamming(F.col("protein"), reference) / F.length(reference))
    rows = read.withColumn("reason", reason)
    passed = F.col("reason").isNull()
    return rows.select(
        F.col("parent").alias("id"), "reason", F.when(passed, F.col("protein_id")).alias("accession"), F.when(passed, F.col("dna")).alias("dna"), F.when(passed, identity).alias("identity"),
        F.when(passed, F.col("located")).alias("parts"),
    )


# Submissions with planted defects: a coding sequence from each run of 90 bases of every record.

RUN = 90
MOTIF = "TGGTGCCATTGGATGTGC"  # WCHWMC in either code
#: What a defect's number must be rejected for; other numbers pass.
DEFECTS = {
    0: "not_one_cds", 1: "accession_mismatch", 2: "accession_mismatch", 3: "wrong_taxon", 4: "pseudo", 5: "pseudogene", 6: "exception", 7: "transl_except",
    8: "ribosomal_slippage", 9: "artificial_location", 10: "partial_frame", 11: "partial_location", 12: "ambiguous_bases", 13: "incomplete_codon",
    14: "length_metadata_mismatch", 15: "sequence_hash_mismatch", 16: "unexpected_genetic_code", 17: "invalid_complete_cds", 18: "invalid_complete_cds",
    19: "translation_mismatch", 20: "not_microprotein", 21: "no_reference_sequence", 22: "reference_identity_below_threshold", 23: "unexpected_genetic_code",
    24: "wrong_taxon", 30: "invalid_complete_cds",
}
VARIANTS = {26: ("C_TERMINAL_EXTENSION", 1.0), 27: ("C_TERMINAL_TRUNCATION", 37 / 38), 28: ("SUBSTITUTION_ONLY", 36 / 37), 29: ("INDEL_VARIANT", 1.0)}
PARENT_DEFECTS = {
    0: "parent_accession_mismatch", 1: "parent_metadata_taxon_mismatch", 2: "undefined_parent_sequence", 3: "parent_length_mismatch", 4: "parent_hash_mismatch", 5: "wrong_taxon",
    6: "missing_annotated_cds", 7: "multiple_annotated_cds", 8: "missing_protein_accession", 9: "remote_or_missing_cds_location", 10: "remote_or_missing_cds_location",
    11: "unsupported_location_operator", 12: "partial_location", 13: "out_of_bounds_cds_location", 14: "invalid_cds_location", 15: "invalid_complete_cds", 16: "partial_frame",
}


def units(spark: SparkSession, sf: str) -> DataFrame:
    """(id, family, expected_table, cds, d, e): complete coding sequences and two numbers from a hash, for defects."""
    runs = F.regexp_extract_all("rna", F.lit(f"[ACGU]{{{RUN}}}"), F.lit(0))
    rows = cds(spark, sf).select("doc_id", "family", F.col("translation_table").alias("expected_table"), F.posexplode(runs).alias("k", "run"))
    sense = F.array_join(F.transform(S.codons(F.col("run")), lambda c: F.when(c.isin("UAA", "UAG", "UGA", "AGA", "AGG"), "CAA").otherwise(F.translate(c, "U", "T"))), "")
    rows = rows.select(F.concat_ws(".", F.concat(F.lit("R"), "doc_id"), F.col("k").cast("string")).alias("id"), "family", "expected_table", sense.alias("body"))
    made = F.concat(F.lit("ATG"), F.substring("body", 1, RUN // 2), F.lit(MOTIF), F.substring("body", RUN // 2 + 1, RUN // 2), F.lit("TAA"))
    byte = lambda at: F.conv(F.substring(F.md5("id"), at, 4), 16, 10).cast("int")
    return rows.select("id", "family", "expected_table", "body", made.alias("cds"), (byte(1) % 48).alias("d"), (byte(5) % 32).alias("e"))


_UNITS_SQL = f"""{CDS_SQL}, run AS (SELECT doc_id, family, translation_table AS expected_table, unnest(regexp_extract_all(rna, '[ACGU]{{{RUN}}}')) AS run, unnest(range(length(rna) // {RUN})) AS k FROM cds),
body AS (SELECT 'R' || doc_id || '.' || k AS id, family, array_to_string(list_transform(regexp_extract_all(run, '...'), lambda c: CASE WHEN c IN ('UAA', 'UAG', 'UGA', 'AGA', 'AGG') THEN 'CAA' ELSE replace(c, 'U', 'T') END), '') AS body FROM run),
unit AS (SELECT id, family, 'ATG' || body[1:{RUN // 2}] || '{MOTIF}' || body[{RUN // 2 + 1}:] || 'TAA' AS cds, ('0x' || substr(md5(id), 1, 4))::INTEGER % 48 AS d, ('0x' || substr(md5(id), 5, 4))::INTEGER % 32 AS e FROM body)"""


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Records for the gates; the number d spoils what DEFECTS says."""
    u = units(spark, sf)
    d = F.col("d")
    stop = F.when(d == 17, F.concat(F.substring("cds", 1, 48), F.lit("TAA"), F.expr("substring(cds, 52)"))).when(d == 18, F.concat(F.lit("CCC"), F.expr("substring(cds, 4)")))
    long = F.concat(F.lit("ATG"), F.repeat(F.concat("body", F.lit(MOTIF)), F.lit(3)), F.lit("TAA"))
    dna = F.coalesce(stop, F.when(d.isin(12, 24), F.overlay("cds", F.lit("N"), F.lit(10))).when(d == 13, F.expr("substring(cds, 1, length(cds) - 1)")).when(d == 20, long).when(d == 30, F.expr("substring(cds, 1, length(cds) - 3)")), F.col("cds"))
    u = u.withColumn("dna", dna).withColumn("true_protein", S.translate_cds(F.translate("cds", "T", "U"), F.col("expected_table")))
    given = S.translate_cds(F.translate("dna", "T", "U"), F.col("expected_table"))
    u = u.withColumn("given", F.when(d == 20, given).otherwise(F.col("true_protein")))
    taxon = F.concat(F.lit("taxon:"), "family")
    p = F.col("true_protein")
    isoform = (
        F.when(d == 22, F.repeat(F.lit("W"), F.length("given"))).when(d == 26, F.expr("substring(true_protein, 1, length(true_protein) - 1)")).when(d == 27, F.concat(p, F.lit("W")))
        .when(d == 28, F.overlay("true_protein", F.lit("P"), F.lit(19))).when(d == 29, F.concat(F.substring("true_protein", 1, 18), F.expr("substring(true_protein, 20)"))).otherwise(F.col("given"))
    )
    barred = F.coalesce(*[F.when(d == 4 + k, F.array(F.lit(name), F.lit("note"))) for k, name in enumerate(BARRED)], F.array(F.lit("note")))
    return u.select(
        "id", F.when(d == 1, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("listed_id"), F.when(d == 2, F.lit("other")).otherwise(F.col("id")).alias("protein_id"),
        F.when(d == 0, 2).otherwise(1).alias("n_cds"), F.when(d.isin(3, 24), F.array(taxon, F.lit("taxon:0"))).otherwise(F.array(taxon, taxon)).alias("taxa"), barred.alias("qualifiers"),
        F.when(d == 10, "2").when(d % 2 == 0, "1").alias("codon_start"),
        F.when(d == 11, "join(<1..40,90..120)").when(d % 3 == 0, F.concat(F.lit("1.."), F.length("dna").cast("string"))).otherwise("complement(join(P1.2:5..90,P1.2:200..224))").alias("location"),
        "dna", (F.length("dna") + F.when(d == 14, 3).otherwise(0)).alias("base_count"), F.when(d == 15, F.md5(F.lit("x"))).when(d != 25, F.md5("dna")).alias("sequence_md5"),
        F.when(d == 16, (3 - F.col("expected_table")).cast("string")).when(d == 23, "one").otherwise(F.col("expected_table").cast("string")).alias("transl_table"),
        F.when(d == 19, F.concat("given", F.lit("K"))).otherwise(F.col("given")).alias("translation"), taxon.alias("expected_taxon"), "expected_table",
        F.when(d == 21, F.array().cast("array<string>")).otherwise(F.array(isoform)).alias("isoforms"),
    )


def _case(numbers: dict[int, str], by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in numbers.items()) + " END"


_RNA_SHA = "CASE WHEN reason IS NULL THEN sha256(replace(cds, 'T', 'U')) END AS sequence_sha256"


@query(
    "P4_complete_gate",
    f"""WITH {_UNITS_SQL}, r AS (SELECT *, {_case(DEFECTS, "d")} AS reason FROM unit)
    SELECT id, reason, CASE WHEN reason IS NULL THEN coalesce({_case({k: str(round(v[1], 6)) for k, v in VARIANTS.items()}, "d")}::DOUBLE, 1.0) END AS identity,
      CASE WHEN reason IS NULL THEN coalesce({_case({k: v[0] for k, v in VARIANTS.items()}, "d")}, 'EXACT_MATCH') END AS variant, {_RNA_SHA} FROM r""",
)
def p4_complete(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL knows which defect was planted; the gate sees only the records."""
    return complete_cds_gate(Scratch(spark, "submissions").write(submissions(spark, sf), "records"))


@query(
    "P5_secondary_gate",
    f"""WITH {_UNITS_SQL}, r AS (SELECT *, {_case(DEFECTS | {26: "reference_length_mismatch", 27: "reference_length_mismatch", 29: "reference_length_mismatch"}, "d")} AS reason FROM unit)
    SELECT id, reason, CASE WHEN reason IS NULL THEN CASE WHEN d = 28 THEN {round(36 / 37, 6)} ELSE 1.0 END END::DOUBLE AS identity, {_RNA_SHA} FROM r""",
)
def p5_secondary(spark: SparkSession, sf: str) -> DataFrame:
    return secondary_gate(Scratch(spark, "submissions").write(submissions(spark, sf), "records"))


#: A parent holds the sequence in two pieces between fixed flanks.
LEFT, INTRON, RIGHT, CUT = "ACGTTGCAAC", "GTAAGTTTAG", "TTGACCA", 30


def parents(spark: SparkSession, sf: str) -> DataFrame:
    """Parent records whose feature lies on either strand, in one piece or two; the number e spoils what PARENT_DEFECTS says."""
    u = units(spark, sf).withColumn("protein", S.translate_cds(F.translate("cds", "T", "U"), F.col("expected_table")))
    e = F.col("e")
    one, minus = e % 4 == 0, e % 4 >= 2
    # of one piece, of two on this strand, of two on the other written in either way
    forward = F.when(one, F.concat(F.lit(LEFT), "cds", F.lit(RIGHT))).otherwise(F.concat(F.lit(LEFT), F.expr(f"substring(cds, 1, {CUT})"), F.lit(INTRON), F.expr(f"substring(cds, {CUT + 1})"), F.lit(RIGHT)))
    u = u.withColumn("forward", forward).withColumn("size", F.length("forward"))
    n, at = F.length("cds"), len(LEFT)
    bounds = [F.lit(at + 1), F.lit(at + CUT), F.lit(at + CUT + len(INTRON) + 1), n + (at + len(INTRON))]
    text = lambda a, b: F.concat(a.cast("string"), F.lit(".."), b.cast("string"))
    flip = lambda x: F.col("size") + 1 - x
    first, second = text(bounds[0], bounds[1]), text(bounds[2], bounds[3])
    back1, back2 = text(flip(bounds[1]), flip(bounds[0])), text(flip(bounds[3]), flip(bounds[2]))
    join = lambda *x: F.concat(F.lit("join("), x[0], F.lit(","), x[1], F.lit(")"))
    comp = lambda x: F.concat(F.lit("complement("), x, F.lit(")"))
    good = F.when(one, text(F.lit(at + 1), n + at)).when(~minus, join(first, second)).when(e % 4 == 2, comp(join(back2, back1))).otherwise(join(comp(back1), comp(back2)))
    place = (
        F.when(e == 9, F.concat(F.lit("join(X9.1:3..9,"), first, F.lit(")"))).when(e == 10, F.lit(None)).when(e == 11, join(first, second).substr(F.lit(5), F.lit(99))).when(e == 12, F.lit("complement(<18..120)"))
        .when(e == 13, F.lit("join(11..40,51..9000)")).when(e == 14, F.lit("join(11..40,")).when(e == 15, join(comp(back2), comp(back1))).otherwise(good)
    )
    place = F.when(e == 11, F.concat(F.lit("order"), place)).otherwise(place)
    feature = lambda kind, gene, location: F.struct(
        F.lit(kind).alias("type"), gene.alias("gene"), F.lit("synthase subunit").alias("product"), F.when(e == 8, "").otherwise(F.concat(F.lit("Q"), "id")).alias("protein_id"), location.alias("location"),
        F.col("expected_table").cast("string").alias("transl_table"), F.col("protein").alias("translation"), F.array(F.lit("note")).alias("qualifiers"), F.when(e == 16, "3").otherwise("1").alias("codon_start"),
    )
    main = feature("CDS", F.when(e == 6, F.lit("atp-z")).otherwise(F.lit("ATP-x")), place)
    features = F.array(feature("gene", F.lit("ATPX"), F.lit("1..20")), feature("CDS", F.lit("COX1"), F.lit("2..10")), main)
    features = F.when(e == 7, F.concat(features, F.array(feature("CDS", F.lit("atpX"), F.lit("1..9"))))).otherwise(features)
    seq = F.when(minus, S.reverse_complement(F.col("forward"))).otherwise(F.col("forward"))
    taxon = F.concat(F.lit("taxon:"), "family")
    u = u.withColumn("sequence", F.when(e != 2, seq))
    return u.select(
        "id", F.when(e == 0, F.lit("P0.1")).otherwise(F.col("id")).alias("listed_id"), F.when(e == 1, F.lit("taxon:0")).otherwise(taxon).alias("tax_id"), taxon.alias("reference_taxon"), "sequence",
        (F.length("sequence") + F.when(e == 3, 1).otherwise(0)).alias("base_count"), F.when(e == 4, F.md5(F.lit(""))).otherwise(F.md5("sequence")).alias("sequence_md5"),
        F.when(e == 5, F.array(F.lit("taxon:1"))).otherwise(F.array(taxon)).alias("taxa"), features.alias("features"), "expected_table", F.array("protein").alias("isoforms"),
    )


@query(
    "P6_feature_extraction",
    f"""WITH {_UNITS_SQL}, r AS (SELECT *, {_case(PARENT_DEFECTS, "e")} AS reason FROM unit)
    SELECT id, reason, CASE WHEN reason IS NULL THEN 'Q' || id END AS accession, CASE WHEN reason IS NULL THEN md5(cds) END AS dna_md5, CASE WHEN reason IS NULL THEN 1.0 END::DOUBLE AS identity,
      CASE WHEN reason IS NULL THEN CASE WHEN e % 4 = 0 THEN 1 ELSE 2 END END AS n_parts FROM r""",
)
def p6_extraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = parent_gate(Scratch(spark, "parents").write(parents(spark, sf), "parents"), ["ATPX", "ATP synthase X"])
    return rows.select("id", "reason", "accession", F.md5("dna").alias("dna_md5"), "identity", F.size("parts").alias("n_parts")).withColumn("n_parts", F.when(F.col("reason").isNull(), F.col("n_parts")))
