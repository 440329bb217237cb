"""Seeded ranking, stratified panels, quotas and places. All draws are by content hash, so they do
not depend on partitioning; top-k ranks are limited before their shuffle by Spark's group limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import CDS_SQL, CODONS_SQL, cds, codon_rows, positions, table

SEED = 17


@query("W1_json_hash_rank", f"""WITH {CDS_SQL} SELECT doc_id, sha256('["sequence",{SEED},"' || sequence_sha256 || '"]') AS rank FROM cds""")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).select("doc_id", S.json_rank("sequence", SEED, F.col("sequence_sha256")).alias("rank"))


@query("W2_text_hash_rank", f"WITH {CDS_SQL} SELECT doc_id, sha256('{SEED}:' || family || ':' || sequence_sha256) AS rank FROM cds")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return cds(spark, sf).select("doc_id", S.text_rank(SEED, F.col("family"), F.col("sequence_sha256")).alias("rank"))


def round_robin(rows: DataFrame, strata: list[str], rank: Column, quota: int, most: int, seed: int = SEED, key: str = "sequence_sha256") -> DataFrame:
    """Up to quota rows of each stratum by rank, taken level by level over strata in hashed order, `most` in all.

    Ties of a rank are broken by key."""
    stratum = S.text_rank(seed, F.lit("stratum"), *[F.col(s) for s in strata])
    ranked = rows.withColumn("__rank", rank)
    level = F.row_number().over(Window.partitionBy(*strata).orderBy("__rank", key))
    ranked = ranked.withColumn("level", level).where(F.col("level") <= quota).withColumn("__stratum", stratum)
    return ranked.orderBy("level", "__stratum", *strata).limit(most).drop("__rank", "__stratum")


_PANEL = f"""{CDS_SQL}, u AS (SELECT family, taxon, sequence_sha256, min(doc_id) AS doc_id FROM cds GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY family, taxon ORDER BY sha256('["sequence",{SEED},"' || sequence_sha256 || '"]'), sequence_sha256) AS level FROM u),
panel AS (SELECT family, taxon, sequence_sha256, doc_id, CAST(level AS INTEGER) AS level FROM r WHERE level <= 16 ORDER BY level, sha256('{SEED}:stratum:' || family || ':' || taxon), family, taxon LIMIT 96)"""


@query("W3_round_robin_panel", f"WITH {_PANEL} SELECT * FROM panel")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return panel(cds(spark, sf))


def panel(records: DataFrame, quota: int = 16, most: int = 96) -> DataFrame:
    """A sampling operator: 16 a stratum, 96 in all."""
    unique = records.groupBy("family", "taxon", "sequence_sha256").agg(F.min("doc_id").alias("doc_id"))
    return round_robin(unique, ["family", "taxon"], S.json_rank("sequence", SEED, F.col("sequence_sha256")), quota, most)


@query(
    "W4_round_robin_by_taxon",
    f"""WITH {CDS_SQL}, u AS (SELECT taxon, sequence_sha256 FROM cds GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY sha256('{SEED}:' || taxon || ':' || sequence_sha256), sequence_sha256) AS level FROM u)
    SELECT taxon, sequence_sha256, CAST(level AS INTEGER) AS level FROM r WHERE level <= 10 ORDER BY level, sha256('{SEED}:stratum:' || taxon), taxon LIMIT 50""",
)
def w4(spark: SparkSession, sf: str) -> DataFrame:
    unique = cds(spark, sf).groupBy("taxon", "sequence_sha256").agg(F.lit(1).alias("x")).drop("x")
    return round_robin(unique, ["taxon"], S.text_rank(SEED, F.col("taxon"), F.col("sequence_sha256")), 10, 50)


def water_fill(available: DataFrame, group: str, n_col: str, budget: int, extra: str) -> DataFrame:
    """(group, quota): one unit a group and pass, groups in order, until the budget is spent; what is
    left goes to the group `extra`. available has a row a group, so its passes are a small table."""
    levels = available.select(group, F.explode(F.sequence(F.lit(1), F.least(F.col(n_col), F.lit(budget)).cast("int"))).alias("level"))
    taken = levels.orderBy("level", group).limit(budget).groupBy(group).agg(F.count("*").alias("quota"))
    used = taken.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("used"))
    return taken.join(used).select(group, (F.col("quota") + F.when(F.col(group) == extra, budget - F.col("used")).otherwise(0)).alias("quota"))


@query(
    "W5_water_filling",
    f"""WITH {CDS_SQL}, a AS (SELECT family, count(DISTINCT sequence_sha256) AS n FROM cds GROUP BY 1), l AS (SELECT family, unnest(range(1, least(n, 200) + 1)) AS level FROM a),
    t AS (SELECT family, count(*) AS quota FROM (SELECT * FROM l ORDER BY level, family LIMIT 200) GROUP BY 1)
    SELECT family, CAST(quota + CASE WHEN family = 'en' THEN 200 - (SELECT sum(quota) FROM t) ELSE 0 END AS BIGINT) AS quota FROM t""",
)
def w5(spark: SparkSession, sf: str) -> DataFrame:
    n = cds(spark, sf).select("family", "sequence_sha256").distinct().groupBy("family").agg(F.count("*").alias("n"))
    return water_fill(n, "family", "n", 200, "en")


def matched_views(rows: DataFrame, view: str, key: str, seed: int = SEED) -> DataFrame:
    """Equally many distinct keys of each view: as many as the smallest has, by seeded rank. Ranks are
    taken within 4096 ranges of the hash, so a view with most of the rows is never sorted in one task."""
    distinct = rows.select(view, key).distinct()
    common = distinct.groupBy(view).agg(F.count("*").alias("n")).agg(F.min("n").alias("common"))
    ranked = distinct.withColumn("rank", S.text_rank(seed, F.col(view), F.col(key)))
    placed = positions(ranked, [view], F.substring("rank", 1, 3), ["rank", key])
    return placed.withColumn("place", (F.col("pos") + 1).cast("int")).join(F.broadcast(common)).where("place <= common").select(view, key, "place")


@query(
    "W6_matched_views",
    f"""WITH {CDS_SQL}, u AS (SELECT DISTINCT family, sequence_sha256 FROM cds), m AS (SELECT min(n) AS common FROM (SELECT count(*) AS n FROM u GROUP BY family)),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sha256('{SEED}:' || family || ':' || sequence_sha256), sequence_sha256) AS place FROM u) SELECT family, sequence_sha256, CAST(place AS INTEGER) AS place FROM r, m WHERE place <= common""",
)
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return matched_views(cds(spark, sf), "family", "sequence_sha256")


def balanced(rows: DataFrame, n: str, seed: int = SEED) -> DataFrame:
    """Up to n (a column, the same for a family) rows of each family, level by level over its taxa in hashed order; within a
    taxon by seeded rank. A level is a place within 4096 ranges of the hash, so no taxon or family is sorted in one task."""
    ranked = rows.withColumn("__rank", S.text_rank(seed, F.col("family"), F.col("sequence_sha256")))
    placed = positions(ranked, ["family", "taxon"], F.substring("__rank", 1, 3), ["__rank", "sequence_sha256"]).withColumnRenamed("pos", "__level").where(F.col("__level") < F.col(n))
    placed = placed.withColumn("__turn", S.text_rank(seed, F.lit("taxon"), F.col("taxon")))
    return positions(placed, ["family"], F.col("__level"), ["__level", "__turn", "taxon"]).where(F.col("pos") < F.col(n)).select(*rows.columns)


def require(checks: list[tuple[str, bool]]) -> None:
    """Raises with the first message whose check is false."""
    for message, holds in checks:
        if not holds:
            raise ValueError(message)


def family_quotas(focus: DataFrame, lead: str) -> tuple[int, DataFrame]:
    """The lead family's rows of the focus, and (family, quota): the other families share up to half of that number, one unit
    a family and pass; the lead has the rest."""
    n = focus.groupBy("family").agg(F.count("*").alias("n"))
    count = focus.where(F.col("family") == lead).count()
    others = n.where(F.col("family") != lead)
    budget = min(others.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], count // 2)
    levels = others.select("family", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(max(budget, 1))).cast("int"))).alias("level"))
    taken = levels.orderBy("level", "family").limit(budget).groupBy("family").agg(F.count("*").alias("quota"))
    return count, taken.unionByName(focus.sparkSession.createDataFrame([(lead, count - budget)], "family string, quota long").where("quota > 0"))


def dependent_views(rows: DataFrame, focus: str, near: list[str], far: list[str], lead: str, seed: int = SEED) -> DataFrame:
    """(view, place, family, taxon, sequence_sha256): three views with the same number of rows of each family, and the pools.

    Each view starts with the same third of the focus taxon's chosen rows. The near view fills up with near taxa, balanced, and
    where they are too few with further focus rows; the far view replaces half of those near rows by far taxa and keeps a
    balanced part of the others. Every step is places within families and joins on the small table of quotas. Raises unless
    the sequences are distinct and their taxa known, the lead family has three rows of the focus and one related family, each
    view meets the quotas, the near view has two near taxa, and the far view two near taxa and a far one."""
    scratch = Scratch(rows.sparkSession, "views")
    rows = scratch.write(rows.select("family", "taxon", "sequence_sha256"), "rows")
    known = F.col("taxon").isin([focus, *near, *far])
    total, odd = rows.agg(F.count("*"), F.count_if(~F.coalesce(known, F.lit(False)))).first()
    unique = rows.select("sequence_sha256").distinct().count()
    require([("the pool holds a sequence twice", unique == total), ("the pool holds an unexpected taxon", odd == 0)])
    pool = rows.where(F.col("taxon") == focus)
    count, quotas = family_quotas(pool, lead)
    require([("the lead family has fewer than three sequences of the focus", count >= 3)])
    quotas = scratch.write(quotas.withColumn("common", F.least("quota", F.greatest(F.lit(1), F.round(F.col("quota") / 3).cast("long")))), "quotas")
    require([("no related family of the focus", quotas.count() >= 2)])
    small = F.broadcast(quotas)  # a row a family, summed over the rows

    ranked = pool.withColumn("rank", S.text_rank(seed, F.col("family"), F.col("sequence_sha256")))
    chosen = positions(ranked, ["family"], F.substring("rank", 1, 3), ["rank", "sequence_sha256"]).drop("rank").join(small, "family").where("pos < quota")
    chosen = scratch.write(chosen, "chosen")
    names = ["family", "taxon", "sequence_sha256"]
    near_rows = rows.where(F.col("taxon").isin(near)).join(small, "family").withColumn("n", F.col("quota") - F.col("common"))
    near_rows = scratch.write(balanced(near_rows, "n", seed).select(*names), "near")
    got = near_rows.groupBy("family").agg(F.count("*").alias("got"))
    state = quotas.join(got, "family", "left").fillna(0, ["got"]).withColumn("missing", F.col("quota") - F.col("common") - F.col("got"))
    far_rows = rows.where(F.col("taxon").isin(far)).join(F.broadcast(state.select("family", F.expr("(got + 1) div 2").alias("n"))), "family")
    far_rows = scratch.write(balanced(far_rows, "n", seed).select(*names), "far")
    added = far_rows.groupBy("family").agg(F.count("*").alias("added"))
    state = scratch.write(state.join(added, "family", "left").fillna(0, ["added"]).withColumn("n", F.col("got") - F.col("added")), "state")
    kept = balanced(near_rows.join(F.broadcast(state.select("family", "n")), "family"), "n", seed).select(*names)
    shared = chosen.join(F.broadcast(state.select("family", "missing")), "family").where("pos < common + missing").select(*names)
    views = {
        "focus_lead": pool.where(F.col("family") == lead),
        "focus": chosen.select(*names),
        "near": shared.unionByName(near_rows),
        "far": shared.unionByName(kept).unionByName(far_rows),
        "all_focus": pool,
        "all_near": rows.where(F.col("taxon").isin([focus, *near])),
        "all": rows,
    }
    out = None
    for name, view in views.items():
        view = view.select(F.lit(name).alias("view"), *names)
        out = view if out is None else out.unionByName(view)
    ranked = out.withColumn("rank", S.text_rank(seed, F.col("family"), F.col("sequence_sha256")))
    placed = scratch.write(positions(ranked, ["view"], F.substring("rank", 1, 3), ["rank", "sequence_sha256"]).select("view", F.col("pos").alias("place"), *names), "views")
    sizes = placed.where(F.col("view").isin("focus", "near", "far")).groupBy("view", "family").agg(F.count("*").alias("n")).join(quotas, "family", "full").where("n IS NULL OR n <> quota")
    taxa = {r.view: r for r in placed.where(F.col("view").isin("near", "far")).groupBy("view").agg(F.count_distinct(F.when(F.col("taxon").isin(near), F.col("taxon"))).alias("near"), F.count_if(F.col("taxon").isin(far)).alias("far")).collect()}
    require([
        ("a family's quota cannot be filled", sizes.limit(1).count() == 0),
        ("the near view has fewer than two near taxa", taxa["near"].near >= 2),
        ("the far view has no far taxon", taxa["far"].far > 0),
        ("the far view has fewer than two near taxa", taxa["far"].near >= 2),
    ])
    return placed


def _rr_sql(name: str, source: str, n: str) -> str:
    """The CTE `name`: n rows of each family from `source`, as balanced() takes them."""
    return f"""{name} AS (SELECT family, taxon, s FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY level, sha256('{SEED}:taxon:' || taxon), taxon) AS place FROM (
  SELECT p.*, row_number() OVER (PARTITION BY family, taxon ORDER BY sha256('{SEED}:' || family || ':' || s), s) AS level FROM {source} p)) JOIN {n} USING (family) WHERE place <= n)"""


_FOCUS, _NEAR, _FAR = ["src1", "src2", "src3", "src4"], [f"src{k}" for k in range(5, 10)], ["src0", *(f"src{k}" for k in range(10, 20))]


@query(
    "W6_dependent_views",
    f"""WITH {CDS_SQL}, pool AS (SELECT s, family, CASE WHEN taxon IN ('{"', '".join(_FOCUS)}') THEN 'focus' WHEN family = 'es' AND taxon <> 'src5' AND taxon IN ('{"', '".join(_NEAR)}') THEN 'src0' ELSE taxon END AS taxon
      FROM (SELECT sequence_sha256 AS s, arg_min(family, doc_id) AS family, arg_min(taxon, doc_id) AS taxon FROM cds GROUP BY 1)),
    hum AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sha256('{SEED}:' || family || ':' || s), s) - 1 AS pos FROM pool WHERE taxon = 'focus'),
    tot AS (SELECT count(*) FILTER (family = 'en') AS c, least(count(*) FILTER (family <> 'en'), count(*) FILTER (family = 'en') // 2) AS budget FROM hum),
    lev AS (SELECT family, row_number() OVER (ORDER BY pos, family) AS r FROM hum WHERE family <> 'en'),
    q AS (SELECT family, count(*) AS quota FROM lev, tot WHERE r <= budget GROUP BY family UNION ALL SELECT 'en', c - budget FROM tot),
    qc AS (SELECT *, least(quota, greatest(1, CAST(round(quota / 3) AS BIGINT))) AS common FROM q), n1 AS (SELECT family, quota - common AS n FROM qc),
    near_pool AS (SELECT * FROM pool WHERE taxon IN ('{"', '".join(_NEAR)}')), far_pool AS (SELECT * FROM pool WHERE taxon IN ('{"', '".join(_FAR)}')),
    {_rr_sql("nr", "near_pool", "n1")}, g AS (SELECT family, quota, common, (SELECT count(*) FROM nr WHERE nr.family = qc.family) AS got FROM qc), n2 AS (SELECT family, (got + 1) // 2 AS n FROM g),
    {_rr_sql("fr", "far_pool", "n2")}, n3 AS (SELECT family, got - (SELECT count(*) FROM fr WHERE fr.family = g.family) AS n FROM g), {_rr_sql("kept", "nr", "n3")},
    shared AS (SELECT h.family, taxon, s FROM hum h JOIN g USING (family) WHERE pos < common + (quota - common - got)),
    v AS (SELECT 'focus_lead' AS view, family, taxon, s FROM hum WHERE family = 'en' UNION ALL SELECT 'focus', family, taxon, s FROM hum JOIN q USING (family) WHERE pos < quota
      UNION ALL SELECT 'near', * FROM shared UNION ALL SELECT 'near', * FROM nr UNION ALL SELECT 'far', * FROM shared UNION ALL SELECT 'far', * FROM kept UNION ALL SELECT 'far', * FROM fr
      UNION ALL SELECT 'all_focus', family, taxon, s FROM hum UNION ALL SELECT 'all_near', family, taxon, s FROM pool WHERE taxon = 'focus' OR taxon IN ('{"', '".join(_NEAR)}') UNION ALL SELECT 'all', family, taxon, s FROM pool)
    SELECT view, row_number() OVER (PARTITION BY view ORDER BY sha256('{SEED}:' || family || ':' || s), s) - 1 AS place, family, taxon, s AS sequence_sha256 FROM v""",
)
def w6_dependent(spark: SparkSession, sf: str) -> DataFrame:
    """Four sources are the focus taxon, five are near, the rest far. Near sequences of one family are scarce, so that it is
    filled with the focus."""
    first = cds(spark, sf).groupBy("sequence_sha256").agg(F.min_by(F.struct("family", "taxon"), "doc_id").alias("f")).select("sequence_sha256", "f.*")
    scarce = (F.col("family") == "es") & (F.col("taxon") != "src5") & F.col("taxon").isin(_NEAR)
    taxon = F.when(F.col("taxon").isin(_FOCUS), "focus").when(scarce, "src0").otherwise(F.col("taxon"))
    return dependent_views(first.withColumn("taxon", taxon), "focus", _NEAR, _FAR, "en")


def anchors(records: DataFrame, gap: int, left: int, seed: int = SEED) -> DataFrame:
    """(doc_id, start, rank): of the starts that leave `left` codons before and the gap inside, the one
    with the least hash. Records too short have no row."""
    n = F.floor(F.length("rna") / 3).cast("int")
    starts = records.select("doc_id", "sequence_sha256", n.alias("n")).where(F.col("n") >= left + gap)
    starts = starts.select("doc_id", "sequence_sha256", F.explode(F.sequence(F.lit(left), F.col("n") - gap)).alias("start"))
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), "sequence_sha256", F.col("start").cast("string")), 256)
    least = starts.select("doc_id", F.struct(rank.alias("rank"), "start").alias("x")).groupBy("doc_id").agg(F.min("x").alias("x"))
    return least.select("doc_id", "x.start", "x.rank")


def anchor_sql(gap: int, left: int) -> str:
    """The CTE anchor, over cds."""
    return f"""s AS (SELECT doc_id, sequence_sha256, unnest(range({left}, length(rna) // 3 - {gap} + 1)) AS start FROM cds WHERE length(rna) // 3 >= {left + gap}),
anchor AS (SELECT doc_id, CAST(arg_min(start, (h, start)) AS INTEGER) AS start, min(h) AS rank FROM (SELECT doc_id, start, sha256('{SEED}:' || sequence_sha256 || ':' || start) AS h FROM s) GROUP BY doc_id)"""


_ANCHOR = f"{CDS_SQL}, {anchor_sql(gap=4, left=4)}"


@query("W7_argmin_anchor", f"WITH {_ANCHOR} SELECT doc_id, start, rank FROM anchor")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return anchors(cds(spark, sf), gap=4, left=4)


@query(
    "W8_focus_panel",
    f"""WITH {CDS_SQL}, u AS (SELECT sequence_sha256, min(doc_id) AS doc_id FROM cds GROUP BY 1) SELECT sequence_sha256, doc_id FROM u ORDER BY sha256('["focus",{SEED},"' || sequence_sha256 || '"]') LIMIT 24""",
)
def w8(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: the 24 sequences of least hash."""
    unique = cds(spark, sf).groupBy("sequence_sha256").agg(F.min("doc_id").alias("doc_id"))
    return unique.orderBy(S.json_rank("focus", SEED, F.col("sequence_sha256"))).limit(24)


@query("W9_previous_codon", f"WITH {CODONS_SQL} SELECT prev, codon, count(*) AS n FROM (SELECT codon, lag(codon) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM codon) WHERE prev IS NOT NULL GROUP BY ALL")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(cds(spark, sf)).groupBy("prev", "codon").agg(F.count("*").alias("n"))


def pairs(records: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, prev, codon) of neighbours, from the codon array against itself: no window, no shuffle."""
    c = S.codons(F.col("rna"))
    rows = records.select(*keep, c.alias("c")).select(*keep, F.posexplode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("p"), F.slice("c", F.lit(2), F.size("c")).alias("q"))))
    return rows.where("col.q IS NOT NULL AND col.p IS NOT NULL").select(*keep, (F.col("pos") + 1).alias("pos"), F.col("col.p").alias("prev"), F.col("col.q").alias("codon"))


@query(
    "W10_cumulative_offsets",
    f"WITH {CDS_SQL} SELECT doc_id, sequence_sha256, CAST(sum(length(rna)) OVER (ORDER BY sequence_sha256, doc_id) - length(rna) AS BIGINT) AS pos FROM cds",
)
def w10(spark: SparkSession, sf: str) -> DataFrame:
    rows = cds(spark, sf).select("doc_id", "sequence_sha256", F.length("rna").cast("long").alias("n"))
    return positions(rows, [], F.substring("sequence_sha256", 1, 3), ["sequence_sha256", "doc_id"], F.col("n")).drop("n")


@query(
    "W11_relative_frequency",
    f"WITH {CODONS_SQL} SELECT family, codon, round(count(*) / sum(count(*)) OVER (PARTITION BY family), 6) + 0.0 AS share FROM codon GROUP BY family, codon",
)
def w11(spark: SparkSession, sf: str) -> DataFrame:
    n = codon_rows(cds(spark, sf), "family").groupBy("family", "codon").agg(F.count("*").alias("n"))
    return n.select("family", "codon", S.r6(F.col("n") / F.sum("n").over(Window.partitionBy("family"))).alias("share"))


@query(
    "W16_shards",
    f"WITH {CDS_SQL} SELECT doc_id, (row_number() OVER (ORDER BY sequence_sha256, doc_id) - 1) // 128 AS shard FROM cds",
)
def w16(spark: SparkSession, sf: str) -> DataFrame:
    placed = positions(cds(spark, sf).select("doc_id", "sequence_sha256"), [], F.substring("sequence_sha256", 1, 3), ["sequence_sha256", "doc_id"])
    return placed.select("doc_id", F.floor(F.col("pos") / 128).alias("shard"))


@query(
    "W17_variable_positions",
    f"""WITH {CODONS_SQL}, v AS (SELECT family, taxon, pos, count(DISTINCT codon) > 1 AS variable FROM codon WHERE pos > 0 GROUP BY ALL)
    SELECT family, taxon, count(*) AS n_positions, count(*) FILTER (variable) AS n_variable FROM v GROUP BY ALL""",
)
def w17(spark: SparkSession, sf: str) -> DataFrame:
    v = variable_positions(cds(spark, sf))
    return v.groupBy("family", "taxon").agg(F.count("*").alias("n_positions"), F.count_if("variable").alias("n_variable"))


def variable_positions(records: DataFrame) -> DataFrame:
    """(family, taxon, pos, variable): two codons or more stand there. The smallest and the largest tell."""
    rows = codon_rows(records, "family", "taxon").where("pos > 0").groupBy("family", "taxon", "pos")
    return rows.agg((F.min("codon") != F.max("codon")).alias("variable"))


@query(
    "W18_event_pairs",
    """WITH o AS (SELECT user_id, event_id, ts, event_type, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_type, next_type, count(*) AS n, CAST(sum(epoch_us(next_ts) - epoch_us(ts)) AS BIGINT) AS idle_us FROM o WHERE next_ts IS NOT NULL GROUP BY ALL""",
)
def w18(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the next one of its user: rows meet by place, which hot users share out by hour."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    placed = positions(events, ["user_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"]).drop("event_id")
    after = placed.select("user_id", (F.col("pos") - 1).alias("pos"), F.col("ts").alias("next_ts"), F.col("event_type").alias("next_type"))
    both = placed.join(after, ["user_id", "pos"])
    idle = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return both.groupBy("event_type", "next_type").agg(F.count("*").alias("n"), F.sum(idle).alias("idle_us"))


@query("W15_hash_sample_rows")
def w15(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: 1000 seeded draws with replacement. A draw is a place, found by hash."""
    draws, rows = 1000, cds(spark, sf).select("doc_id", "sequence_sha256")
    placed = positions(rows, [], F.substring("sequence_sha256", 1, 3), ["sequence_sha256", "doc_id"])
    n = rows.agg(F.count("*").alias("n"))
    picks = spark.range(draws, numPartitions=1).withColumnRenamed("id", "draw").join(F.broadcast(n)).where("n > 0")
    picks = picks.select("draw", F.pmod(F.xxhash64(F.lit(SEED), "draw"), "n").alias("pos"))
    return placed.join(F.broadcast(picks), "pos").select("draw", "doc_id")
