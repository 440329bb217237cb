"""Gap cases and model inputs: regions of a case, control tokens, padded batches, span corruption, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import sequence as S
from ..registry import query
from ..sources.views import CDS_SQL, CODONS_SQL, cds, table
from .sampling import _ANCHOR, anchors


def case_regions(records: DataFrame, chosen: DataFrame, gap: int, left: int, right: int, *keep: str) -> DataFrame:
    """(doc_id, keep, case_id, start, prefix, truth, suffix): the bases before, in and after each chosen gap."""
    rows = records.join(chosen.select("doc_id", "start"), "doc_id")
    at = 3 * F.col("start")
    rows = rows.select(
        "doc_id",
        *keep,
        "start",
        F.substring("rna", at - 3 * left + 1, F.lit(3 * left)).alias("prefix"),
        F.substring("rna", at + 1, F.lit(3 * gap)).alias("truth"),
        F.substring("rna", at + 3 * gap + 1, F.lit(3 * right)).alias("suffix"),
    )
    return rows.withColumn("case_id", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string"), F.lit(str(gap)), F.lit(str(left)), F.lit(str(right))), 256))


@query(
    "F29_case_regions",
    f"""WITH {_ANCHOR} SELECT doc_id, start, substr(rna, 3 * start - 11, 12) AS prefix, substr(rna, 3 * start + 1, 12) AS truth, substr(rna, 3 * start + 13, 6) AS suffix,
      sha256(doc_id || ':' || start || ':4:4:2') AS case_id FROM cds JOIN anchor USING (doc_id)""",
)
def f29(spark: SparkSession, sf: str) -> DataFrame:
    records = cds(spark, sf)
    return case_regions(records, anchors(records, gap=4, left=4), 4, 4, 2)


#: Control tokens stand before the codons in the vocabulary; fixed.
CONTROL = ("<PAD>", "<UNK>", "<BOS>", "<EOS>", "<MASK>", "<SEP>", "<F1>", "<F2>")


def encode_with_controls(rna: F.Column, frame: int = 0) -> F.Column:
    """Ids with BOS and EOS around the codons read from `frame`; what is no codon is UNK. T counts as U."""
    text = F.regexp_extract_all(F.substring(S.to_rna(rna), F.lit(frame + 1), F.length(rna)), F.lit("(.{3})"), F.lit(1))
    one = lambda c: F.when(c.rlike("^[ACGU]{3}$"), S.codon_index(c) + len(CONTROL)).otherwise(CONTROL.index("<UNK>"))
    return F.concat(F.array(F.lit(CONTROL.index("<BOS>"))), F.transform(text, one), F.array(F.lit(CONTROL.index("<EOS>"))))


@query(
    "F16_encode_with_controls",
    f"""WITH {CODONS_SQL}, i AS (SELECT doc_id, pos, 8 + 16 * (instr('AUCG', codon[1]) - 1) + 4 * (instr('AUCG', codon[2]) - 1) + instr('AUCG', codon[3]) - 1 AS id FROM codon)
    SELECT doc_id, count(*) + 2 AS n, md5('2,' || string_agg(id::VARCHAR, ',' ORDER BY pos) || ',3') AS ids_md5 FROM i GROUP BY doc_id""",
)
def f16(spark: SparkSession, sf: str) -> DataFrame:
    rows = cds(spark, sf).select("doc_id", encode_with_controls(F.col("rna")).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def padded(rows: DataFrame, ids: str, batch: str, pad: int = 0) -> DataFrame:
    """Adds the batch's width, the padded ids and how many are real; a batch's width is a grouped maximum."""
    width = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("width"))
    joined = rows.join(width, batch)
    return joined.withColumn("real", F.size(ids)).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad), F.col("width") - F.size(ids))))


@query(
    "F24_padded_batches",
    f"""WITH {CDS_SQL}, l AS (SELECT doc_id, family || '/' || doc_id // 16 AS batch, length(rna) // 3 AS n FROM cds) SELECT doc_id, batch, max(n) OVER (PARTITION BY batch) AS width, n AS real, max(n) OVER (PARTITION BY batch) - n AS n_pad FROM l""",
)
def f24(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a family's neighbours; their real ids are 1 or more, so zeros are padding."""
    ids = F.transform(S.codons(F.col("rna")), lambda c: S.codon_index(c) + 1)
    rows = cds(spark, sf).select("doc_id", F.concat_ws("/", "family", F.floor(F.col("doc_id") / 16).cast("string")).alias("batch"), ids.alias("ids"))
    out = padded(rows, "ids", "batch")
    zeros = F.size(F.filter("ids", lambda x: x == 0)).cast("long")
    return out.select("doc_id", "batch", F.col("width").cast("long").alias("width"), F.col("real").cast("long").alias("real"), zeros.alias("n_pad"))


def span_corruption(ids: F.Column, every: int, span: int, mask: int) -> tuple[F.Column, F.Column]:
    """Input with each span (the first `span` of each `every` ids) replaced by one mask, and the ids taken out."""
    numbered = F.transform(ids, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.filter(numbered, lambda p: p["i"] % every >= span - 1)
    source = F.transform(kept, lambda p: F.when(p["i"] % every == span - 1, mask).otherwise(p["x"]))
    target = F.transform(F.filter(numbered, lambda p: p["i"] % every < span), lambda p: p["x"])
    return source, target


@query(
    "N2_span_corruption",
    f"""WITH {CODONS_SQL}, i AS (SELECT doc_id, pos, 16 * (instr('AUCG', codon[1]) - 1) + 4 * (instr('AUCG', codon[2]) - 1) + instr('AUCG', codon[3]) - 1 AS id FROM codon)
    SELECT doc_id, count(*) FILTER (pos % 10 >= 2) AS n_source, count(*) FILTER (pos % 10 < 3) AS n_target, md5(coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (pos % 10 < 3), '')) AS target_md5 FROM i GROUP BY doc_id""",
)
def n2(spark: SparkSession, sf: str) -> DataFrame:
    ids = cds(spark, sf).select("doc_id", F.transform(S.codons(F.col("rna")), lambda c: S.codon_index(c)).alias("ids"))
    source, target = span_corruption(F.col("ids"), 10, 3, 64)
    return ids.select("doc_id", F.size(source).cast("long").alias("n_source"), F.size(target).cast("long").alias("n_target"), F.md5(F.array_join(target, ",")).alias("target_md5"))


def model_size(spark: SparkSession, widths: list[int], layers: list[int], vocabulary: int) -> DataFrame:
    """(width, layers, parameters, training_bytes) of a decoder with tied head: 12 w² and 13 w a layer."""
    grid = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, widths))).alias("width")).withColumn("layers", F.explode(F.array(*map(F.lit, layers))))
    w = F.col("width").cast("long")
    parameters = vocabulary * w + F.col("layers") * (12 * w * w + 13 * w) + 2 * w
    return grid.withColumn("parameters", parameters).withColumn("training_bytes", 16 * F.col("parameters"))


@query(
    "F31_model_size",
    f"""WITH {CDS_SQL}, t AS (SELECT family, CAST(sum(length(rna) // 3) AS BIGINT) AS tokens FROM cds GROUP BY family),
    m AS (SELECT CAST(w AS INTEGER) AS width, CAST(l AS INTEGER) AS layers, 72 * w + l * (12 * w * w + 13 * w) + 2 * w AS parameters FROM unnest([48::BIGINT, 96, 192, 256, 384]) a(w), unnest([2::BIGINT, 3, 4, 6]) b(l))
    SELECT family, width, layers, parameters, 16 * parameters AS training_bytes, tokens, CAST(6 * parameters * tokens AS DOUBLE) AS training_flops FROM m, t""",
)
def f31(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of models, and what a pass over each family's tokens costs them."""
    tokens = cds(spark, sf).groupBy("family").agg(F.sum(F.floor(F.length("rna") / 3)).alias("tokens"))
    sizes = F.collect_list(F.struct("width", "layers", "parameters", "training_bytes"))  # a fixed grid
    grid = model_size(spark, [48, 96, 192, 256, 384], [2, 3, 4, 6], len(codes.CODONS) + len(CONTROL)).agg(sizes.alias("g"))
    rows = tokens.join(F.broadcast(grid)).select("family", "tokens", F.inline("g"))
    return rows.withColumn("training_flops", (6 * F.col("parameters") * F.col("tokens")).cast("double"))


@query("S2_S20_record_list", f"WITH {CDS_SQL} SELECT accession, sequence_sha256, length(rna) AS n FROM cds")
def s20(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).select("accession", "sequence_sha256", F.length("rna").cast("long").alias("n"))


@query(
    "A28_order_chained_digest",
    """WITH RECURSIVE o AS (SELECT event_type, event_id, event_id // 1000 AS run, row_number() OVER (PARTITION BY event_type, user_id, event_id // 1000 ORDER BY event_id) AS k, user_id FROM events),
    t AS (SELECT event_type, user_id, run, k, sha256('' || event_id) AS trace FROM o WHERE k = 1 UNION ALL SELECT o.event_type, o.user_id, o.run, o.k, sha256(t.trace || o.event_id) FROM t JOIN o ON o.event_type = t.event_type AND o.user_id = t.user_id AND o.run = t.run AND o.k = t.k + 1),
    r AS (SELECT event_type, user_id, run, arg_max(trace, k) AS trace, max(k) AS n FROM t GROUP BY ALL),
    s AS (SELECT event_type, user_id, run // 1000 AS run, sha256(string_agg(trace, '' ORDER BY run)) AS trace, sum(n) AS n FROM r GROUP BY ALL)
    SELECT event_type, user_id, sha256(string_agg(trace, '' ORDER BY run)) AS trace, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY ALL""",
)
def a28(spark: SparkSession, sf: str) -> DataFrame:
    """A digest over a user's events of a type in order of event_id: a chain over the events of each run of
    1000 ids, then digests of a thousand runs' traces, then one of those. A single chain would need all events
    of a hot user in one task; here no array is longer than a thousand events or runs, or a millionth of the ids."""
    keys = ["event_type", "user_id"]
    runs = table(spark, sf, "events").groupBy(*keys, F.expr("event_id div 1000").alias("run")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    chain = F.aggregate("ids", F.lit(""), lambda acc, x: F.sha2(F.concat(acc, x.cast("string")), 256))
    traces = runs.select(*keys, "run", chain.alias("trace"), F.size("ids").cast("long").alias("n"))
    for level in (F.expr("run div 1000"), F.lit(0)):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("run", "trace"))), lambda x: x.trace)
        traces = traces.groupBy(*keys, level.alias("above")).agg(F.sha2(F.array_join(ordered, ""), 256).alias("trace"), F.sum("n").alias("n"))
        traces = traces.withColumnRenamed("above", "run")
    return traces.drop("run")
