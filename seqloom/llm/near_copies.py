"""Near copies: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come from three searches. SimHash fingerprints within 2 bits (simhash.links) find the closest copies; at a
similarity of 0.8 fingerprints differ in about ten bits, where segment bit counts tell copies from strangers no more, so
MinHash bands search the rest: BANDS keys, each made of ROWS minima. Two documents of similarity s share a key with chance
1 - (1 - s^6)^24: 0.999 at 0.8. Every candidate is held against the exact Jaccard similarity of the two sets before it is
linked, so nothing is linked wrongly.

Whoever shares a key is first held against the smallest and the largest node there, never against all, so a crowded key
gives two stars. Documents of one template crowd keys without being copies of each other; a true pair among them is then
not compared. So all nodes of keys of four nodes or more that still hold several components go through a third search that
loses no pair, however many meet: with a set's shingles ordered from the rarest among these nodes on, let the first one that
two sets have in common stand at i and j. They share n - i + 1 and m - j + 1 at most, which a similarity of t must reach. So i
is among the larger set's first n - ceil(t n) + 1, and j among the smaller one's first m - ceil(2t m / (1 + t)) + 1. What a template
shares is frequent, comes last and is beyond these places unless the sets are nearly equal. Nodes of one component are not paired.

Documents of one shingle set are one node (a 128-bit digest). Defined results: null or blank texts have the empty set and are
copies of each other; fewer words than a shingle: the whole sequence is the shingle; texts of any length are read whole;
repeated rows are one node; one row of each component is kept, that with the smallest id (null ids last, then any one of
equals); all columns of df come back, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..plans.storage import Scratch, unused
from .joins import keep_keys
from .simhash import SEED, SLICE_HASHES, links, majority_bits, shingle_hashes

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6
#: Nodes of one shingle beyond which its largest component is set apart, so that its nodes are joined with the others only.
CROWD = 64
MARKS = "struct<node:binary,n:int,fp:long,keys:array<long>>"


def _factors() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
    return made[0] | np.uint64(1), made[1]


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of the texts whose hashes begin at starts; no text is without a hash."""
    import xxhash

    times, plus = _factors()
    least = np.stack([np.minimum.reduceat(hashes * t + p, starts) for t, p in zip(times, plus, strict=True)], axis=1)
    rows = least.reshape(len(starts), BANDS, ROWS)
    digest = xxhash.xxh64_intdigest
    return np.array([[digest(band.tobytes(), k) for k, band in enumerate(text)] for text in rows], np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _marks_of(texts: list[bytes], width: int) -> list[dict]:
    import xxhash

    sets = [shingle_set(t, width) for t in texts]
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    fps = majority_bits(flat, size).view(np.int64).tolist()
    full = np.flatnonzero(size)
    keys = band_keys(flat, (np.cumsum(size) - size)[full]).view(np.int64).tolist() if len(full) else []
    keys = dict(zip(full.tolist(), keys, strict=True))
    node = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
    return [{"node": d, "n": len(s), "fp": f, "keys": keys.get(k, [])} for k, (d, s, f) in enumerate(zip(node, sets, fps, strict=True))]


def marks(width: int = WIDTH):
    """A column function: node (digest of the shingle set), its size, fingerprint and band keys."""
    kind = pa.struct([("node", pa.binary()), ("n", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf(MARKS)
    def made(texts: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for text in texts.cast(pa.binary()):
            held.append(text.as_py() or b"")
            size += len(held[-1])
            if size > 4 * SLICE_HASHES:
                out, held, size = out + _marks_of(held, width), [], 0
        return pa.array(out + _marks_of(held, width), kind)

    return made


def hash_set(width: int = WIDTH):
    """A column function: the distinct shingle hashes of a text."""

    @F.arrow_udf("array<long>")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py() or b"", width).view(np.int64) for t in texts.cast(pa.binary())], pa.list_(pa.int64()))

    return made


def _pairs(x: str, y: str) -> list[F.Column]:
    """(a, b, na, nb) of two structs (node, n), a the greater."""
    high, low = F.greatest(x, y), F.least(x, y)
    return [high["node"].alias("a"), low["node"].alias("b"), high["n"].alias("na"), low["n"].alias("nb")]


def _candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb) with a > b: nodes that share a band key or have fingerprints within 2 bits, as stars."""
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    at = F.struct("node", "n")
    ends = keyed.groupBy("key").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low.node < high.node")
    met = keyed.join(ends, "key").select(at.alias("x"), F.explode(F.array("low", "high")).alias("y"))
    fps = scratch.write(nodes.where("n > 0").groupBy("fp").agg(F.min(at).alias("rep")), "fingerprints")
    same = nodes.where("n > 0").join(fps, "fp").select(at.alias("x"), F.col("rep").alias("y"))
    near = links(fps).join(fps, "fp").select("hub", F.col("rep").alias("x"))
    near = near.join(fps.select(F.col("fp").alias("hub"), F.col("rep").alias("y")), "hub").select("x", "y")
    return met.unionByName(same).unionByName(near).where("x.node <> y.node").select(*_pairs("x", "y")).distinct()


def _like_sizes(threshold: float) -> F.Column:
    return F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9


def _places(share: float) -> F.Column:
    """Of n ordered shingles those one of which is shared with any set that has this share of them."""
    return F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1


def _crowded(nodes: DataFrame, parts: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb, ca, cb): all candidates of different components ca and cb among the nodes of crowded keys, by their
    rarest shingles."""
    keyed = nodes.select("node", F.explode("keys").alias("key")).join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("part").alias("low"), F.max("part").alias("high")).where("k > 3 AND low < high")
    crowded = scratch.write(crowded.select("key"), "crowded")
    some = keyed.join(crowded, "key").groupBy("node").agg(F.min("part").alias("part"))
    tokens = some.join(sets, "node").select("node", F.size("hashes").alias("n"), "part", F.explode("hashes").alias("token"))
    tokens = scratch.write(tokens, "tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "token"))
    first = tokens.join(shared, "token", "left").withColumn("rank", rank).where((F.col("rank") <= _places(threshold)) & F.col("df").isNotNull())
    first = scratch.write(first.select("token", "node", "n", "part", "rank"), "first")

    counted = first.groupBy("token", "part").agg(F.count("*").alias("k")).groupBy("token")
    counted = counted.agg(F.max(F.struct("k", "part")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("parts")).where("parts > 1")
    met = first.join(counted.select("token", "k", F.col("most.part").alias("largest")), "token")
    met = met.select("token", "node", "n", "part", "rank", ((F.col("k") > CROWD) & (F.col("part") == F.col("largest"))).alias("main"))
    met = scratch.write(met, "met")
    at = F.struct("node", "n", "part", "rank")
    ahead = met.where(F.col("rank") <= _places(2 * threshold / (1 + threshold)))
    ahead = ahead.select("token", at.alias("x"), F.explode(F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("main"))
    pairs = ahead.join(met.select("token", "main", at.alias("y")), ["token", "main"])
    pairs = pairs.where("x.part <> y.part AND (x.n < y.n OR x.n = y.n AND x.node < y.node)")
    most = F.least(F.expr("x.n - x.rank"), F.expr("y.n - y.rank")) + 1
    pairs = pairs.where(most >= threshold / (1 + threshold) * F.expr("x.n + y.n") - 1e-9)
    high, low = F.greatest("x", "y"), F.least("x", "y")
    named = {"a": high["node"], "b": low["node"], "na": high["n"], "nb": low["n"], "ca": high["part"], "cb": low["part"]}
    return pairs.select(*[c.alias(k) for k, c in named.items()]).where(_like_sizes(threshold)).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose sets have a Jaccard similarity of threshold or more."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(shared >= threshold * (F.col("na") + F.col("nb") - shared) - 1e-9).select("a", "b")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """df's columns of one row of each group of near copies."""
    scratch = Scratch(df.sparkSession, "near-copies")
    mark, row = unused(df, "__mark"), unused(df, "__row")
    made = marks(width)(F.col(text_col).cast("string"))
    rows = scratch.write(df.select(*df.columns, made.alias(mark), F.monotonically_increasing_id().alias(row)), "rows")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    first = rows.select(f"{mark}.*", order.alias("best"))
    nodes = scratch.write(first.groupBy("node").agg(F.min("best").alias("best"), *[F.any_value(c).alias(c) for c in ("n", "fp", "keys")]), "nodes")

    pairs = scratch.write(_candidates(nodes, scratch), "candidates")
    wanted = scratch.write(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", F.col("best.row").alias(row)), "wanted")
    texts = keep_keys(rows, wanted.select(row), row).select(F.col(f"{mark}.node").alias("node"), hash_set(width)(F.col(text_col).cast("string")).alias("hashes"))
    sets = scratch.write(texts, "sets")

    sure = scratch.write(_verified(pairs.where(_like_sizes(threshold)), sets, threshold), "stars")
    parts = scratch.write(connected_components(sure, "a", "b"), "parts")
    rest = scratch.write(_crowded(nodes, parts, sets, threshold, scratch), "rest")
    more = _verified(rest, sets, threshold).join(rest, ["a", "b"]).select("ca", "cb").distinct()
    # components of components: only those with a new link take part
    upper = connected_components(scratch.write(more, "others"), "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("upper"))
    whole = nodes.join(parts, "node", "left").select("best", F.coalesce("component", "node").alias("component")).groupBy("component").agg(F.min("best").alias("best"))
    grouped = whole.join(upper, "component", "left").groupBy(F.coalesce("upper", "component").alias("part")).agg(F.min("best").alias("best"))
    return rows.join(grouped.select(F.col("best.row").alias(row)), row, "left_semi").select(*df.columns)
