"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in order of their names take the weights in turn and share a part of all words in proportion;
nobody's target passes `most` times its own words, and what is over is shared again by weight until nobody's does.

Blocks: a source's documents stand in a seeded order and are cut into shards of about SHARD words, whole documents
each; a shard's words are a stream cut into blocks of BLOCK words (only a shard's last may be shorter). A source's
votes are its target counted in its own blocks. Sainte-Lague gives the house of blocks to the sources by highest
quotients votes / (2 k + 1), and then each source's blocks to its shards in the same way, which yields an integer
quota for every shard. A shard of N blocks with quota q is taken q div N times as a whole, and q mod N of its blocks,
chosen by a seeded permutation of their numbers, once more.

Seats are not dealt one by one. With V votes of m members in all, any divisor V / (house - m / 2 - 1) gives each member
no more seats than Sainte-Lague does, and V / (house + m / 2 + 1) no fewer; only the at most 2 m + 2 quotients in
between are ranked, by places(), so neither a house of billions nor a source with most of the shards meets in a task.

All of it is DataFrame functions. Words move only as counts: a row has an id, a source, a size. The driver sees the
two sums of each round of sharing. Everything that decides is an integer or one division of integers, and orders come
from SHA-256, so reruns agree. Defined results: a null text has no words and is taken with none; a source without words
has target 0; null sources are one, the last; rows with one id are documents each, and equal rows are interchangeable;
null ids take part; a document of any length is taken over all its blocks; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import Scratch
from .places import places

WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
BLOCK, SHARD, SEED = 16, 2**14, "mix"
#: Votes are counted in thousandths of a block.
FINE = 1000
#: Multipliers of the permutations: primes above any number of blocks in a shard (fixed values).
PRIMES = (998244353, 1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097)
_WORD, _WHITE = "[^\\x20\\x09-\\x0D]+", " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; none in null. Nothing larger than the text is made."""
    marks = F.translate(F.regexp_replace(text, _WORD, "x"), _WHITE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def _digits(text: Column, at: int) -> Column:
    """Eight hex digits of a text's SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(text, 256), at, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share_percent: int, most: int) -> DataFrame:
    """sources (key, place, source_size; a written table) with target: min(most * size, level * weight)."""
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights)).cast("long")
    rows = sources.withColumns({"w": weight, "cap": F.col("source_size") * most})
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    over, under = 0, None
    capped = F.lit(False)
    while True:
        found = rows.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0))).first()
        if tuple(found) == (over, under):
            break
        over, under = found
        # level = (share * total - what the capped ones take) / weights of the others
        part = (F.col("w") * (share_percent * total - 100 * over)).cast("double") / F.lit(100 * max(under, 1))
        capped = capped | (F.col("cap") <= part) if under else F.lit(True)
    return rows.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(part) if total else F.lit(0.0)).drop("w", "cap")


def apportion(members: DataFrame, houses: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(grp, member, votes, seats) by Sainte-Lague. members: (grp, member, votes), a written table without nulls; houses:
    (grp, house). Equal quotients go to the smaller member; nobody without votes gets a seat."""
    sums = members.groupBy("grp").agg(F.sum("votes").alias("all_votes"), F.sum((F.col("votes") > 0).cast("long")).alias("m"))
    sums = houses.join(sums, "grp").withColumns({"low": F.col("house") - F.col("m") / 2 - 1, "high": F.col("house") + F.col("m") / 2 + 1})

    def seats_at(quotas: str) -> Column:
        return F.floor(F.col("votes") / (F.col("all_votes") / F.col(quotas)) + 0.5)

    some = (F.col("votes") > 0) & (F.col("house") > 0)
    base = F.when(some & (F.col("low") > 0), seats_at("low")).otherwise(F.lit(0))
    upto = F.when(some, seats_at("high")).otherwise(F.lit(0))
    found = scratch.write(members.join(sums, "grp").withColumns({"base": base, "upto": upto}).select("grp", "member", "votes", "house", "base", "upto"), f"{name}-between")
    open_seats = found.groupBy("grp").agg((F.max("house") - F.sum("base")).alias("left_over"))
    next_ones = found.where("upto > base").select("grp", "member", "votes", F.explode(F.sequence("base", F.col("upto") - 1)).alias("k"))
    ranked = places(next_ones.select("grp", "member", (-F.col("votes") / (2 * F.col("k") + 1)).alias("minus_quotient")), ["grp"], ["minus_quotient", "member"], scratch, f"{name}-ranked")
    more = ranked.join(open_seats, "grp").where("place < left_over").groupBy("grp", "member").agg(F.count("*").alias("more"))
    seats = F.col("base") + F.coalesce("more", F.lit(0))
    return scratch.write(found.join(more, ["grp", "member"], "left").select("grp", "member", "votes", seats.alias("seats")), f"{name}-seats")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: str = SEED,
) -> DataFrame:
    """(id_col, source_col, size, source_size, target, whole, pieces) of every row: the document is taken `whole` times, and
    the words of each piece (first, last: from 0, end exclusive) once more."""
    scratch = Scratch(df.sparkSession, "mix")
    source = F.col(f"`{source_col}`").cast("string")
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), key.alias("key"), word_count(F.col(f"`{text_col}`")).alias("size"))
    rows = rows.withColumns({"slots": F.greatest("size", F.lit(1)), "h": F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 16)})
    rows = scratch.write(rows, "sized")
    sources = scratch.write(rows.groupBy("key").agg(F.sum("size").alias("source_size")), "sources")
    sources = targets(scratch.write(places(sources, [], ["key"], scratch, "named"), "placed"), weights, share_percent, most)

    # shards of whole documents; the empty ones count as a word here, so that no number of them crowds a shard
    rows = places(rows, ["key"], ["h", "id", "size"], scratch, "ordered", weight="slots").withColumn("shard", F.expr(f"place div {shard}"))
    earlier = Window.partitionBy("key", "shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = scratch.write(rows.select("key", "shard", "id", "source", "size", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start")), "streams")
    cells = rows.groupBy("key", "shard").agg(F.ceil(F.sum("size") / block).alias("n"))
    cells = scratch.write(cells.select(F.col("key").alias("grp"), F.col("shard").alias("member"), F.col("n").alias("votes")), "cells")

    blocks = cells.groupBy(F.col("grp").alias("key")).agg(F.sum("votes").alias("blocks"))
    fine = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") * FINE)).otherwise(F.lit(0))
    sources = scratch.write(sources.join(blocks, "key").withColumn("votes", fine.cast("long")), "targets")
    house = sources.agg(F.greatest(F.expr(f"(2 * sum(votes) - {FINE} * sum(cast(votes > 0 as long))) div {2 * FINE}"), F.lit(0)).alias("house"))
    quotas = apportion(sources.select(F.lit("").alias("grp"), F.col("key").alias("member"), "votes"), house.select(F.lit("").alias("grp"), "house"), scratch, "sources")
    quotas = apportion(cells, quotas.select(F.col("member").alias("grp"), F.col("seats").alias("house")), scratch, "shards")

    name = F.concat_ws(":", F.lit(seed), "grp", "member")
    prime = F.get(F.array(*[F.lit(p).cast("long") for p in PRIMES]), _digits(name, 1) % len(PRIMES))
    cells = quotas.select(
        F.col("grp").alias("key"), F.col("member").alias("shard"), F.col("votes").alias("n"), prime.alias("times"), _digits(name, 9).alias("plus"),
        F.when(F.col("votes") > 0, F.expr("seats div votes")).otherwise(F.lit(0)).alias("whole"), F.when(F.col("votes") > 0, F.col("seats") % F.col("votes")).otherwise(F.lit(0)).alias("extra"),
    )
    cells = scratch.write(cells.join(sources.select("key", "source_size", "target"), "key"), "quotas")
    rows = rows.join(cells, ["key", "shard"]).withColumn("end", F.col("start") + F.col("size"))

    def is_chosen(k: Column) -> Column:
        return (F.col("times") * k + F.col("plus")) % F.col("n") < F.col("extra")

    def words(k: Column) -> Column:
        return F.struct((F.greatest("start", k * block) - F.col("start")).alias("first"), (F.least("end", (k + 1) * block) - F.col("start")).alias("last"))

    touched = F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))
    pieces = F.when((F.col("size") > 0) & (F.col("extra") > 0), F.transform(F.filter(touched, is_chosen), words)).otherwise(F.array().cast("array<struct<first:long,last:long>>"))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "whole", pieces.alias("pieces"))


def taken(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, size, source_size, target, taken): words taken of each document, repeats counted."""
    more = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["last"] - p["first"])
    return rows.select(id_col, "size", "source_size", "target", (F.col("whole") * F.col("size") + more).alias("taken"))


def _number(text: str, at: int) -> str:
    return f"CAST('0x' || substr(sha256({text}), {at}, 8) AS BIGINT)"


#: Seats by plain enumeration of every quotient.
SQL = f"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size FROM documents
), src AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)} AS BIGINT) + 1] AS w FROM sized GROUP BY key
), walk AS (
  SELECT *, coalesce(sum({MOST} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS under, sum(source_size) OVER () AS total
  FROM src WINDOW o AS (ORDER BY source_size / w, key)
), level AS (  -- the first source, by size for a weight, that stays below its bound
  SELECT min_by({SHARE_PERCENT} * total - 100 * over, source_size / w) AS above, min_by(under, source_size / w) AS under
  FROM walk WHERE {MOST} * source_size > CAST(w * ({SHARE_PERCENT} * total - 100 * over) AS DOUBLE) / (100 * under)
), t AS (
  SELECT key, source_size, least(CAST({MOST} * source_size AS DOUBLE), CAST(w * above AS DOUBLE) / (100 * under)) AS target FROM src, level
), placed AS (
  SELECT *, (coalesce(sum(greatest(size, 1)) OVER (PARTITION BY key ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS place
  FROM (SELECT *, substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS h FROM sized)
), stream AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY key, shard ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT *, CAST(place // {SHARD} AS BIGINT) AS shard FROM placed)
), cell AS (SELECT key, shard, CAST(ceil(sum(size) / {BLOCK}) AS BIGINT) AS n FROM stream GROUP BY key, shard
), vote AS (
  SELECT key, source_size, target, blocks, CASE WHEN source_size > 0 THEN CAST(floor(target * blocks / source_size * {FINE}) AS BIGINT) ELSE 0 END AS votes
  FROM t JOIN (SELECT key, CAST(sum(n) AS BIGINT) AS blocks FROM cell GROUP BY key) USING (key)
), house AS (SELECT greatest((2 * sum(votes) - {FINE} * count(*) FILTER (votes > 0)) // {2 * FINE}, 0) AS house FROM vote
), seat AS (
  SELECT key, count(*) AS seats FROM (
    SELECT key, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, key) AS r FROM (SELECT key, votes, unnest(range({MOST} * blocks + 2)) AS k FROM vote WHERE votes > 0)
  ), house WHERE r <= house GROUP BY key
), quota AS (
  SELECT key, shard, count(*) AS q FROM (
    SELECT key, shard, seats, row_number() OVER (PARTITION BY key ORDER BY n / (2 * k + 1) DESC, shard) AS r
    FROM (SELECT c.*, s.seats, unnest(range({MOST} * c.n + 2)) AS k FROM cell c JOIN seat s USING (key))
  ) WHERE r <= seats GROUP BY key, shard
), chosen AS (
  SELECT c.*, coalesce(q, 0) AS q, [{", ".join(map(str, PRIMES))}][{_number(f"'{SEED}:' || key || ':' || shard", 1)} % {len(PRIMES)} + 1] AS times, {_number(f"'{SEED}:' || key || ':' || shard", 9)} AS plus
  FROM cell c LEFT JOIN quota USING (key, shard)
), taken AS (
  SELECT doc_id, key, size, CASE WHEN size = 0 THEN 0 ELSE q // n * size + coalesce(list_sum(list_transform(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1),
    lambda k: CASE WHEN (times * k + plus) % n < q % n THEN least(start + size, (k + 1) * {BLOCK}) - greatest(start, k * {BLOCK}) ELSE 0 END)), 0) END AS taken
  FROM stream JOIN chosen USING (key, shard)
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken FROM taken JOIN t USING (key)
"""
