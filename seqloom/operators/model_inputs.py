"""Model inputs from whole records: an encoder that reads control tokens in brackets, and the infill transform. All in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import sequence as S
from ..registry import query
from ..sources.views import CDS_SQL, CODONS_SQL, cds

#: Control tokens, before the bases or codons in the vocabulary (fixed values, in this order).
CONTROLS = ("[PAD]", "[UNK]", "[BOS]", "[EOS]", "[MASK]", "[FRAME_0]", "[FRAME_1]", "[FRAME_2]")
UNK, BOS, EOS, FRAME_0 = (CONTROLS.index(t) for t in ("[UNK]", "[BOS]", "[EOS]", "[FRAME_0]"))
_NAMED = r"\[[A-Z0-9_]+\]"
#: A token in brackets, or all up to the next one.
_PIECE = rf"({_NAMED}|(?:(?!{_NAMED})[\s\S])++)"


def encode(text: F.Column, width: int = 3, frame: F.Column | None = None, add_bos: bool = False, add_eos: bool = False) -> F.Column:
    """struct<ids, problem>: ids of the control tokens in brackets and of the runs of `width` letters between them, after a
    frame's token and [BOS], before [EOS] if asked for. T reads as U; what is in no vocabulary, names in brackets included, is
    [UNK].

    Defined results: without a text, with a frame other than 0 to 2, or with a stretch between tokens that is no multiple of
    `width`, ids are null and problem says which; an empty text has no ids of its own; a bracket that holds no name counts as
    letters."""
    if width not in (1, 3):
        raise ValueError("a token has one letter or three")
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))
    named = lambda p: p.rlike(rf"^{_NAMED}$")
    letters = "|".join(codes.CODONS) if width == 3 else "|".join(codes.BASES)
    number = (lambda c: S.codon_index(c)) if width == 3 else (lambda c: F.instr(F.lit(codes.BASES), c) - 1)
    one = lambda c: F.when(c.rlike(f"^(?:{letters})$"), number(c) + len(CONTROLS)).otherwise(UNK)
    control = lambda p: F.array(F.when(F.array_position(F.array(*map(F.lit, CONTROLS)), p) > 0, F.array_position(F.array(*map(F.lit, CONTROLS)), p).cast("int") - 1).otherwise(UNK))
    run = lambda p: F.transform(F.regexp_extract_all(F.translate(p, "T", "U"), F.lit(rf"([\s\S]{{{width}}})"), F.lit(1)), one)
    body = F.flatten(F.transform(pieces, lambda p: F.when(named(p), control(p)).otherwise(run(p))))
    head = [F.array(frame.cast("int") + FRAME_0)] if frame is not None else []
    ids = F.concat(*head, *([F.array(F.lit(BOS))] if add_bos else []), body, *([F.array(F.lit(EOS))] if add_eos else []))
    partial = F.exists(pieces, lambda p: ~named(p) & (F.length(p) % width != 0))
    problem = F.when(text.isNull(), "no_text")
    if frame is not None:
        problem = problem.when(~F.coalesce(frame.isin(0, 1, 2), F.lit(False)), "unknown_frame")
    problem = problem.when(partial, "incomplete_stretch")
    return F.struct(F.when(problem.isNull(), ids).alias("ids"), problem.alias("problem"))


def decode(ids: F.Column, width: int = 3) -> F.Column:
    """The text of ids of encode(); its result encodes to the same ids. Ids outside the vocabulary are [UNK]."""
    words = [*CONTROLS, *(codes.CODONS if width == 3 else codes.BASES)]
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(F.array(*map(F.lit, words)), i), F.lit(CONTROLS[UNK]))), "")


def _marked(rna: F.Column, k: F.Column) -> F.Column:
    """Texts with tokens: before, between, unknown, DNA letters, and a stretch that is cut."""
    half = (F.floor(F.length(rna) / 6) * 3).cast("int")
    left, right = F.substring(rna, F.lit(1), half), F.substring(rna, half + 1, F.length(rna))
    return F.when(k == 1, F.concat(F.lit("[MASK]"), rna)).when(k == 2, F.concat(left, F.lit("[MASK][NOPE_1]"), right)).when(k == 3, F.concat(F.translate(rna, "U", "T"), F.lit("[EOS]NNN"))).when(k == 4, F.concat(rna, F.lit("[PAD]AC"))).otherwise(rna)


_MARKED = f"""{CDS_SQL}, tx AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 4 AS frame, CASE doc_id % 5 WHEN 1 THEN '[MASK]' || rna WHEN 2 THEN substr(rna, 1, length(rna) // 6 * 3) || '[MASK][NOPE_1]' || substr(rna, length(rna) // 6 * 3 + 1)
  WHEN 3 THEN replace(rna, 'U', 'T') || '[EOS]NNN' WHEN 4 THEN rna || '[PAD]AC' ELSE rna END AS text FROM cds),
tk AS (SELECT doc_id, k, frame, list_transform(regexp_extract_all(text, '\\[[A-Z0-9_]+\\]|[^\\[]{{3}}'), lambda c: CASE c WHEN '[MASK]' THEN 4 WHEN '[EOS]' THEN 3 WHEN '[PAD]' THEN 0 WHEN '[NOPE_1]' THEN 1 WHEN 'NNN' THEN 1
  ELSE 8 + 16 * (instr('AUCG', replace(c, 'T', 'U')[1]) - 1) + 4 * (instr('AUCG', replace(c, 'T', 'U')[2]) - 1) + instr('AUCG', replace(c, 'T', 'U')[3]) - 1 END) AS ids FROM tx)"""


@query(
    "F16_bracket_tokens",
    f"""WITH {_MARKED}, p AS (SELECT *, CASE WHEN frame = 3 THEN 'unknown_frame' WHEN k = 4 THEN 'incomplete_stretch' END AS problem FROM tk)
    SELECT doc_id, problem, CASE WHEN problem IS NULL THEN len(ids) + 3 END AS n, CASE WHEN problem IS NULL THEN md5((5 + frame) || ',2,' || array_to_string(ids, ',') || ',3') END AS ids_md5, CASE WHEN problem IS NULL THEN true END AS same FROM p""",
)
def f16_brackets(spark: SparkSession, sf: str) -> DataFrame:
    """Whole records with tokens in them; what is decoded encodes to the same ids."""
    rows = cds(spark, sf).select("doc_id", _marked(F.col("rna"), F.col("doc_id") % 5).alias("text"), (F.col("doc_id") % 4).alias("frame"))
    rows = rows.withColumn("e", encode(F.col("text"), frame=F.col("frame"), add_bos=True, add_eos=True)).select("doc_id", "e.ids", "e.problem")
    again = encode(decode(F.col("ids")))["ids"]
    return rows.select("doc_id", "problem", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids_md5"), (again == F.col("ids")).alias("same"))


def infill(ids: F.Column, seed: F.Column, percent: int = 50, psm_percent: int = 50, ignore: int = -100) -> F.Column:
    """struct<form, first, second, ids, targets> of a record's ids under a hex seed (a digest): with a chance of `percent`, and
    more than four ids, cut at two places and put together as prefix, suffix, middle (psm) or suffix, prefix, middle (spm);
    targets hold the middle where it now stands and `ignore` elsewhere. Others are plain: ids as they are, nothing to predict.

    The four 8-digit groups of the seed decide whether, the two cuts (1 <= first < second < n), and the form. Null ids give
    null; equal seeds and ids give equal results, whatever the partitioning."""
    h = lambda k: F.conv(F.substring(seed, 8 * k + 1, 8), 16, 10).cast("long")
    n = F.size(ids)
    cut = F.when(ids.isNotNull() & (n > 4) & (h(0) % 100 < percent), 1 + h(1) % F.greatest(n - 3, F.lit(1)))
    first = cut.cast("int")
    second = (first + 1 + h(2) % F.greatest(n - 2 - first, F.lit(1))).cast("int")
    psm = h(3) % 100 < psm_percent
    prefix, middle, suffix = F.slice(ids, F.lit(1), first), F.slice(ids, first + 1, second - first), F.slice(ids, second + 1, n)
    moved = F.when(psm, F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    blank = lambda k: F.array_repeat(F.lit(ignore), k)
    return F.when(
        ids.isNotNull(),
        F.struct(
            F.when(first.isNull(), "plain").when(psm, "psm").otherwise("spm").alias("form"), first.alias("first"), second.alias("second"),
            F.when(first.isNull(), ids).otherwise(moved).alias("ids"), F.when(first.isNull(), blank(n)).otherwise(F.concat(blank(n - (second - first)), middle)).alias("targets"),
        ),
    )


_H = "('0x' || substr(seed, {0}, 8))::BIGINT"


@query(
    "N2_infill_transform",
    f"""WITH {CODONS_SQL}, i AS (SELECT doc_id, list(8 + 16 * (instr('AUCG', codon[1]) - 1) + 4 * (instr('AUCG', codon[2]) - 1) + instr('AUCG', codon[3]) - 1 ORDER BY pos) AS ids FROM codon GROUP BY doc_id),
    s AS (SELECT doc_id, ids, len(ids) AS n, sha256('infill:' || doc_id) AS seed FROM i),
    a AS (SELECT *, CASE WHEN n > 4 AND {_H.format(1)} % 100 < 50 THEN 1 + {_H.format(9)} % (n - 3) END AS a FROM s), b AS (SELECT *, a + 1 + {_H.format(17)} % greatest(n - 2 - a, 1) AS b FROM a),
    f AS (SELECT *, CASE WHEN a IS NULL THEN 'plain' WHEN {_H.format(25)} % 100 < 50 THEN 'psm' ELSE 'spm' END AS form FROM b)
    SELECT doc_id, form, CAST(a AS INTEGER) AS first, CAST(b AS INTEGER) AS second,
      md5(array_to_string(CASE form WHEN 'plain' THEN ids WHEN 'psm' THEN list_concat(list_concat(ids[1:a], ids[b + 1:]), ids[a + 1:b]) ELSE list_concat(list_concat(ids[b + 1:], ids[1:a]), ids[a + 1:b]) END, ',')) AS ids_md5,
      md5(array_to_string(CASE form WHEN 'plain' THEN list_transform(ids, lambda x: -100) ELSE list_concat(list_transform(range(n - (b - a)), lambda x: -100), ids[a + 1:b]) END, ',')) AS targets_md5 FROM f""",
)
def n2_infill(spark: SparkSession, sf: str) -> DataFrame:
    ids = encode(F.col("rna"))["ids"]
    rows = cds(spark, sf).select("doc_id", ids.alias("ids"), F.sha2(F.concat(F.lit("infill:"), "doc_id"), 256).alias("seed"))
    rows = rows.select("doc_id", infill(F.col("ids"), F.col("seed")).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "form", "first", "second", F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.md5(F.array_join("targets", ",")).alias("targets_md5"))
