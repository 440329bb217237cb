"""URL filters: exact membership of hosts through a cascade of Bloom filters, then path rules.

Level 1 holds the listed keys, level 2 those unlisted keys of the corpus that level 1 lets through,
level 3 the listed keys that level 2 lets through, and so on, until a level lets nothing wrong
through. As the levels are built over the complete set of the corpus's keys, the first level that
turns a key down decides about it without error: an odd one says unlisted, an even one listed.

Keys enter as two 64-bit hashes computed by Spark, and are dealt to shards by a third one: a shard of the
cascade has SHARD_KEYS listed keys or so, whatever the length of the list, and is a few MB. All shards are
built at once, level by level: Spark ORs the words of each shard's level, and the sets still to encode
shrink from level to level and stay tables. Which keys are listed is one grouping of both tables, no join.
The levels reach the keys in one of two ways, with the same filters: as a broadcast while all of them have
BROADCAST_BYTES at most, and beyond that as rows that are sorted in front of their shard's keys, so that a
task holds one shard's levels at a time. There, a shard's keys are dealt into parts by the number of rows (SALTS at least), so a key that
many rows have is not all in one task.

Defined results: a null url or one without "://" has an empty host and path, fits no rule and is
allowed, unless the empty host itself is listed; null keys are in no set; repeated keys count
once; urls and keys of any length are read whole; an empty list allows and an empty corpus gives an empty
result; in_list() keeps all columns, and names its own out_col, lengthened by _ while that name is taken;
judge() reads no other columns than page_id and url.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import Scratch, unused

#: Rules (verdict, host, path), fixed.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Names whose hosts are listed, fixed.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Listed keys of a shard (about), bytes of levels that are broadcast, least parts of a shard beyond that, rows for a part of all shards.
SHARD_KEYS, BROADCAST_BYTES, SALTS, PART_ROWS, MAX_LEVELS = 1 << 20, 8_000_000, 16, 4_000_000, 64


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in positions(number, self.bits, self.hashes, h1, h2):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def positions(number: int, bits: int, hashes: int, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
    """Places of keys in a level; every level mixes the hashes anew."""
    x = (h1.astype(np.int64).view(np.uint64) ^ (np.uint64(0x9E3779B97F4A7C15) * np.array([number + 1], np.uint64))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    step = (h2.astype(np.int64).view(np.uint64) + np.uint64(number)) * np.uint64(0xC4CEB9FE1A85EC53) | np.uint64(1)
    for _ in range(hashes):
        yield ((x >> np.uint64(20)) % np.uint64(bits)).astype(np.uint64)
        x = x + step


def shape(n_keys: int, error: float) -> tuple[int, int]:
    """Bits and hashes of a filter."""
    bits = max(64, math.ceil(-n_keys * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(-math.log2(error)))


def _listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """What a shard's levels say about keys of its universe."""
    out, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    for k, level in enumerate(levels):
        at = np.flatnonzero(open_)
        inside = level.has(k, h1[at], h2[at])
        # turned down here: listed if the level holds unlisted keys
        out[at[~inside]] = k % 2 == 1
        open_[at[~inside]] = False
    out[open_] = len(levels) % 2 == 1
    return out


def _encode(keys: DataFrame, number: int, bits: int, hashes: int) -> DataFrame:
    """(shard, level, bits, hashes, words binary) of the shards that have keys."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shard = pdf.shard.to_numpy()
            for s in np.unique(shard):
                mine = pdf[shard == s]
                at = np.unique(np.concatenate(list(positions(number, bits, hashes, mine.h1.to_numpy(), mine.h2.to_numpy()))))
                word = at >> np.uint64(6)
                new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), new)
                yield pd.DataFrame({"shard": s, "word": word[new].astype(np.int64), "mask": mask.view(np.int64)})

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:  # bits / 64 rows at most
        words = np.zeros(-(-bits // 64), np.uint64)
        words[pdf["word"].to_numpy(np.int64)] = pdf["mask"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": pdf.shard.iloc[:1], "level": number, "bits": bits, "hashes": hashes, "words": [words.tobytes()]})

    marked = keys.select("shard", "h1", "h2").mapInPandas(mark, "shard long, word long, mask long").groupBy("shard", "word").agg(F.bit_or("mask").alias("mask"))
    return marked.groupBy("shard").applyInPandas(dense, "shard long, level int, bits long, hashes int, words binary")


def _tested(df: DataFrame, h1: str, h2: str, shard: str, levels: DataFrame, out_col: str, test) -> DataFrame:
    """df with a boolean column: what test(levels of its shard, h1, h2) says of each row."""
    spark = df.sparkSession
    n_bytes = levels.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]

    def say(known: dict[int, list[Level]], s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), bool)
        for one in np.unique(s):
            mine = np.flatnonzero(s == one)
            out[mine] = test(known.get(one, []), a[mine], b[mine])
        return out

    def level(r) -> Level:
        return Level(r["bits"], r["hashes"], np.frombuffer(r["words"], np.uint64))

    if n_bytes <= BROADCAST_BYTES:
        held: dict[int, list[Level]] = {}
        for r in sorted(levels.collect(), key=lambda r: r["level"]):  # BROADCAST_BYTES at most
            held.setdefault(r["shard"], []).append(level(r))
        shared = spark.sparkContext.broadcast(held)

        @F.pandas_udf("boolean")
        def member(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(say(shared.value, s.to_numpy(), a.to_numpy(), b.to_numpy()))

        return df.withColumn(out_col, member(shard, h1, h2))

    # as many parts of a shard as hold the rows even if one shard has most of them
    salts = max(SALTS, -(-df.count() // PART_ROWS))
    own, salt, names = unused(df, "__levels"), unused(df, "__salt"), df.columns
    rows = df.withColumns({own: F.lit(None).cast("struct<level:int,bits:bigint,hashes:int,words:binary>"), salt: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts).cast("long"))})
    heads = levels.select(F.col("shard").alias(shard), F.struct("level", "bits", "hashes", "words").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias(salt))
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition(shard, salt).sortWithinPartitions(shard, salt, F.col(own).isNull(), f"{own}.level")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[Level]] = {}
        last = 0
        for batch in batches:
            is_row, s = batch.column(own).is_null().to_numpy(zero_copy_only=False), batch.column(shard).to_numpy(zero_copy_only=False)
            # runs of levels and of rows alternate; levels hold for the shard's rows behind them
            for run in np.split(np.arange(len(s)), np.flatnonzero(is_row[1:] != is_row[:-1]) + 1) if len(s) else ():
                part = batch.slice(run[0], len(run))
                if is_row[run[0]]:
                    said = say(known, s[run], *(part.column(c).to_numpy(zero_copy_only=False) for c in (h1, h2)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(said)], [*names, out_col])
                    continue
                for r in part.select([shard, own]).to_pylist():
                    # a shard's first level, or another part of the shard begins
                    if known.keys() != {r[shard]} or r[own]["level"] <= last:
                        known = {r[shard]: []}
                    known[r[shard]].append(level(r[own]))
                    last = r[own]["level"]

    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BooleanType())])
    return dealt.mapInArrow(stream, schema)


def _hashes(key: F.Column, shards: int) -> list[F.Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit("second")), F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards).cast("long"))]


def build_cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch, key: str = "key") -> tuple[DataFrame, int]:
    """(shard, level, bits, hashes, words) of the cascade of the keys in `listed` over all keys in `universe`; shards."""
    marked = listed.select(F.col(key).alias("key"), F.lit(True).alias("inside"), F.lit(False).alias("met"))
    marked = marked.unionByName(universe.select(F.col(key).alias("key"), F.lit(False).alias("inside"), F.lit(True).alias("met")))
    marked = marked.where("key IS NOT NULL").groupBy("key").agg(F.max("inside").alias("inside"), F.max("met").alias("met"))
    # listed keys that the corpus lacks are asked by nobody
    keys = scratch.write(marked.where("met").select("key", "inside"), "keys")
    n, n_others = keys.agg(F.count_if("inside"), F.count_if(~F.col("inside"))).first()
    shards = max(1, -(-n // SHARD_KEYS))
    hashed = scratch.write(keys.select(*[h.alias(c) for h, c in zip(_hashes(F.col("key"), shards), ("h1", "h2", "shard"), strict=True)], "inside"), "hashed")
    current, against = hashed.where("inside").drop("inside"), hashed.where("NOT inside").drop("inside")
    error = min(0.5, max(1e-4, n * math.sqrt(0.5) / max(n_others, 1)))
    levels = None
    for number in range(MAX_LEVELS):
        # one shape for all shards: that of the fullest
        most = current.groupBy("shard").count().agg(F.max("count")).first()[0]
        if not most:
            break
        made = scratch.write(_encode(current, number, *shape(most, error)), f"words-{number}")
        levels = made if levels is None else levels.unionByName(made)
        wrong = _tested(against, "h1", "h2", "shard", made, "passes", lambda own, a, b, k=number: own[0].has(k, a, b) if own else np.zeros(len(a), bool))
        current, against, error = scratch.write(wrong.where("passes").drop("passes"), f"level-{number}"), current, 0.5
    else:
        raise RuntimeError("the cascade does not end: keys of both sides have equal hashes")
    empty = keys.sparkSession.createDataFrame([], "shard long, level int, bits long, hashes int, words binary")
    return (empty if levels is None else levels), shards


def in_list(df: DataFrame, key: str, listed: DataFrame, out_col: str = "listed") -> DataFrame:
    """df with a boolean column: whether its key is in listed (a DataFrame with that key)."""
    out_col = unused(df, out_col)
    levels, shards = build_cascade(listed, df, Scratch(df.sparkSession, "cascade"), key)
    names = [unused(df, f"__h{k}") for k in range(3)]
    tested = df.withColumns(dict(zip(names, _hashes(F.col(key), shards), strict=True)))
    tested = _tested(tested, *names, levels, out_col, _listed)
    return tested.select(*df.columns, (F.col(key).isNotNull() & F.col(out_col)).alias(out_col))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: F.Column, path: F.Column) -> tuple[F.Column, F.Column]:
    """The longest fitting rule as host and path, and its verdict; null for none."""
    rule = verdict = None
    for word, at, prefix in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name = F.lit(at + prefix)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    return rule, verdict


def listed_hosts(hosts: DataFrame, names: tuple[str, ...] = LISTED_NAMES) -> DataFrame:
    """Hosts with one of the names between dots."""
    return hosts.where(F.arrays_overlap(F.split("host", "\\."), F.array(*[F.lit(n) for n in names])))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every url."""
    host, path = host_and_path(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path")).fillna("", ["host", "path"])


def judge(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of the rows of parsed(): a rule's verdict, else block for a host in `listed`."""
    tested = in_list(rows, "host", listed)
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return tested.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE
  {" ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{x}') THEN '{h}{x}'" for _, h, x in sorted(RULES, key=lambda r: -len(r[1] + r[2])))}
  END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{x}' THEN '{v}'" for v, h, x in RULES)}
  WHEN list_has_any(string_split(host, '.'), [{", ".join(f"'{n}'" for n in LISTED_NAMES)}]) THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
