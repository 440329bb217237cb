"""Exact top-k inner products by norm buckets.

Vectors are grouped by length: a range partitioning by number of components, then descending length
(ties by id, so equal vectors spread), cut into buckets of CHUNK vectors and CHUNK_BYTES at most, one
row each. Queries get a lower bound of their k-th best score from the LEADERS longest vectors of their
width, and with it the least length that a better candidate must have (bound / own length). They are
ordered by that need and packed into blocks, so a block's queries need about the same. Blocks meet
buckets by their numbers first: parts of the range that are too short for a block are never listed.
Only then the queries' vectors move to the buckets; candidates never do.

In a bucket the bound becomes a local cosine threshold. Above COORDINATE_FROM, coordinate pruning keeps
the vectors whose normalised values lie in the feasible interval on the query's strongest coordinates;
below it, length pruning keeps the leading run of long enough vectors. What is left is multiplied out
exactly. A task keeps the k best of a query over all the buckets it sees and raises the query's bound
with them. Every vector is compared or excluded by a bound, so the result is exact.

Defined results: vectors that are null or hold null or non-finite components (also after scaling) take
no part; null ids take no part; an empty vector is one like any other. Only vectors with equally many
components have a product, so each width is searched by itself. Components of any size are exact
integers; a score beyond a long is held at the end of its range. Zero vectors score zero and may be
returned; ties go to the smaller id; rows with one id are separate candidates but never those of a
query with that id, and as queries they share one ranking; fewer than k candidates give fewer rows; an
empty table gives an empty result; other columns are not read, whatever their names. Ids are integers of at
most 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import Scratch

#: Vectors and bytes of a bucket, of a block of queries, leaders of a width, and widths that have leaders.
CHUNK, CHUNK_BYTES, QUERY_BLOCK, QUERY_BYTES, LEADERS, LED_WIDTHS = 8192, 8_000_000, 1024, 2_000_000, 2048, 8
COORDINATE_FROM, FOCUS = 0.5, 3
#: Groups of parts in the summary that blocks are held against, and blocks a task keeps results of.
GROUPS, HELD_BLOCKS = 1024, 64
#: Scores of one matrix product (16 MB).
PRODUCTS = 2_000_000
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Integer products below this are exact in doubles.
EXACT = 2.0**53
#: Bounds stay within this: beyond it scores may be held at an end of their range, where ids decide.
SURE = 9.2e18


def quantise(df: DataFrame, asked: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, asked, v array<double>, width, square): floor(scale * x) of every component of the complete vectors."""

    def step(c):
        y = c.cast("double") * scale
        return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)  # a larger double is whole

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.transform(F.col(vector_col), step).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    return rows.withColumns({"width": F.size("v"), "square": F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)})


PACKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("width", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("bounds", pa.binary()), ("longest", pa.float64()), ("need", pa.float64())])


def _pack(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Runs of equally wide rows (id, width, v, square, bound, need) of a partition, a row each: numbers as binary."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def out() -> pa.RecordBatch:
            values = {
                "part": part,
                "block": part << 24 | made,
                "width": held[0]["width"],
                "n": len(held),
                "ids": np.array([r["id"] for r in held], np.int64).tobytes(),
                "vectors": np.array([r["v"] for r in held], np.float64).tobytes(),
                "bounds": np.array([r["bound"] for r in held], np.float64).tobytes(),
                "longest": max(r["square"] for r in held) ** 0.5,
                "need": min(r["need"] for r in held),
            }
            return pa.RecordBatch.from_pylist([values], PACKED)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["width"] != row["width"] or len(held) >= most or len(held) * row["width"] * 8 >= most_bytes):
                    yield out()
                    made, held = made + 1, []
                held.append(row)
        if held:
            yield out()

    ddl = "part int, block long, width int, n int, ids binary, vectors binary, bounds binary, longest double, need double"
    return rows.select("id", "width", "v", "square", "bound", "need").mapInArrow(pack, ddl)


def _slack(width: int, lengths: np.ndarray) -> np.ndarray:
    """How far a product of doubles may be from the exact one, by the product of the lengths."""
    return lengths * ((width + 2) * 2.3e-16)


def _first_bounds(queries: DataFrame, leaders: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Adds bound, below or at the k-th best score among the leaders, and need, the length that it takes to reach it."""
    shared = queries.sparkSession.sparkContext.broadcast(leaders)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = np.full(len(pdf), -np.inf)
            for width, (ids, matrix) in shared.value.items():
                mine = np.flatnonzero(pdf.width.to_numpy() == width)
                for a in range(0, len(mine) if len(ids) > k else 0, QUERY_BLOCK):
                    at = mine[a : a + QUERY_BLOCK]
                    v = np.array(pdf.v.iloc[at].tolist(), np.float64).reshape(len(at), width)
                    lengths = np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((matrix * matrix).sum(axis=1))[None, :]
                    scores = v @ matrix.T - _slack(width, lengths)
                    scores[pdf.id.to_numpy()[at, None] == ids[None, :]] = -np.inf
                    low[at] = np.partition(scores, -k, axis=1)[:, -k]
            low = np.minimum(low, SURE)
            length = np.sqrt(pdf.square.to_numpy())
            need = np.where((low > 0) & (length > 0), low / np.maximum(length, 1e-300), 0.0)
            yield pdf.assign(bound=low, need=need)

    return queries.select("id", "width", "v", "square").mapInPandas(bound, "id long, width int, v array<double>, square double, bound double, need double")


def _candidates(q: np.ndarray, bound: float, unit: np.ndarray, length: np.ndarray) -> tuple[int, np.ndarray | None]:
    """Rows of a bucket (in order of descending length) that may reach the bound, by one of the two prunings: the number of
    leading rows, or with coordinate pruning the rows themselves."""
    norm = float(np.sqrt(np.dot(q, q)))
    if bound <= 0 or norm == 0 or not len(length):
        # a bound of zero or less excludes nothing by length; a zero query scores zero everywhere
        return (len(length) if bound <= 0 else 0), None
    slack = 1 - 1e-9
    if length[0] == 0 or (local := bound / (norm * length[0])) * slack > 1:
        return 0, None
    reach = int(np.searchsorted(-length, -(bound / norm) * slack, "right"))
    if local < COORDINATE_FROM:
        return reach, None
    unit_q, keep, local = q / norm, np.ones(reach, bool), min(local, 1.0)
    for f in np.argsort(-np.abs(unit_q))[:FOCUS]:
        # a vector within the angle arccos(local) of the query; the axis itself may lie within it
        centre = unit_q[f] * local
        width = np.sqrt(max(0.0, 1 - local * local) * max(0.0, 1 - unit_q[f] ** 2)) + 1e-7
        low = -np.inf if unit_q[f] < -local else centre - width
        high = np.inf if unit_q[f] > local else centre + width
        keep &= (unit[:reach, f] >= low) & (unit[:reach, f] <= high)
    return reach, np.flatnonzero(keep)


def _products(q: np.ndarray, some: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `some` that may be among its k best, with their exact products, held in the range of a long."""
    near, norm = some @ q, float(np.sqrt(np.dot(q, q)))
    places = np.arange(len(some))
    if norm * lengths.max(initial=0.0) < EXACT:
        return places, near.astype(np.int64)
    slack = _slack(len(q), norm * lengths)
    if len(some) > k:
        edge = min(np.partition(near - slack, -k)[-k], SURE)
        places = places[near + slack >= edge] if edge > -SURE else places
    whole = [int(x) for x in q.tolist()]
    exact = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in some[places].tolist()]
    return places, np.array([min(max(x, LOWEST), HIGHEST) for x in exact], np.int64)


class _Block:
    """A block's queries in a task, with the k best of each so far."""

    def __init__(self, row: dict, k: int):
        self.k, self.ids = k, np.frombuffer(row["q_ids"], np.int64)
        self.queries = np.frombuffer(row["q_vectors"], np.float64).reshape(len(self.ids), -1)
        self.bounds = np.frombuffer(row["q_bounds"], np.float64).copy()
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray, unit: np.ndarray) -> None:
        """Queries that keep leading rows are multiplied with them together, a matrix of PRODUCTS scores at a time."""
        runs = []
        for i, q in enumerate(self.queries):
            reach, chosen = _candidates(q, float(self.bounds[i]), unit, length)
            if chosen is None and reach and float(np.sqrt(np.dot(q, q))) * length[0] < EXACT:
                runs.append((i, reach))
            elif reach:
                some = np.arange(reach) if chosen is None else chosen
                some = some[ids[some] != self.ids[i]]
                if len(some):
                    places, scores = _products(q, vectors[some], length[some], self.k)
                    self.keep(i, ids[some[places]], scores)
        runs.sort(key=lambda x: x[1])
        step = max(1, PRODUCTS // max(1, len(ids)))
        for a in range(0, len(runs), step):
            at, reach = (np.array(x) for x in zip(*runs[a : a + step], strict=True))
            near = self.queries[at] @ vectors[: reach.max()].T
            hit = near >= self.bounds[at, None]  # what is below the bound is in no query's k best
            hit &= (np.arange(reach.max()) < reach[:, None]) & (ids[None, : reach.max()] != self.ids[at, None])
            which, places = np.nonzero(hit)
            ends = np.searchsorted(which, np.arange(1, len(at)))
            for i, row, mine in zip(at, near, np.split(places, ends), strict=True):
                if len(mine):
                    self.keep(i, ids[mine], row[mine].astype(np.int64))

    def keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merges new scores of a query into its k best and raises its bound."""
        if len(scores) > 4 * self.k:
            some = scores >= np.partition(scores, -self.k)[-self.k]
            ids, scores = ids[some], scores[some]
        held_scores, held_ids = self.best[i]
        scores, mine = np.append(held_scores, scores), np.append(held_ids, ids)
        first = np.lexsort((mine, ~scores))[: self.k]  # ~x falls as x rises, without overflow
        self.best[i] = scores[first], mine[first]
        if len(first) == self.k:
            self.bounds[i] = max(self.bounds[i], min(float(scores[first[-1]]), SURE))

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        columns = (np.repeat(self.ids, n), np.concatenate([i for _, i in self.best]), np.concatenate([s for s, _ in self.best]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Block] = {}
        last = ids = vectors = length = unit = None
        for batch in batches:
            for j in range(batch.num_rows):
                row = {name: batch.column(name)[j].as_py() for name in batch.schema.names}
                if row["block"] != last:
                    last, ids = row["block"], np.frombuffer(row["ids"], np.int64)
                    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
                    length = np.sqrt((vectors * vectors).sum(axis=1))
                    unit = vectors / np.maximum(length, 1e-300)[:, None]
                if row["q_block"] not in held:
                    if len(held) == HELD_BLOCKS:
                        yield held.pop(next(iter(held))).rows()
                    held[row["q_block"]] = _Block(row, k)
                held[row["q_block"]].meet(ids, vectors, length, unit)
        for block in held.values():
            yield block.rows()

    return search


def _leaders(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width: ids and vectors of its LEADERS longest; of the LED_WIDTHS most frequent widths, the widest left out
    where all would exceed 64 MB."""
    widths = vectors.groupBy("width").count().orderBy(F.desc("count"), "width").limit(LED_WIDTHS).collect()
    chosen = [w["width"] for w in widths]
    most = max(1, min(LEADERS, 64_000_000 // (8 * max(1, sum(chosen)))))
    order = Window.partitionBy("width").orderBy(F.desc("square"), "id")
    rows = vectors.where(F.col("width").isin(chosen)).select("id", "width", "v", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)
    out: dict[int, list] = {w: [] for w in chosen}
    for r in rows.collect():  # LED_WIDTHS * LEADERS rows and 64 MB at most
        out[r["width"]].append((r["id"], r["v"]))
    return {w: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.float64).reshape(len(x), w)) for w, x in out.items()}


def top_products(df: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row."""
    scratch = Scratch(df.sparkSession, "topk")
    vectors = scratch.write(quantise(df, is_query, id_col, vector_col), "vectors")
    n, size = vectors.agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0)) * 8).first()

    parts = max(1, -(-n // CHUNK), -(-size // CHUNK_BYTES))
    order = ("width", F.desc("square"), "id")
    ordered = vectors.withColumns({"bound": F.lit(0.0), "need": F.lit(0.0)}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = scratch.write(_pack(ordered, CHUNK, CHUNK_BYTES), "buckets")

    asked = vectors.where("asked")
    bounded = scratch.write(_first_bounds(asked, _leaders(vectors), k), "bounded")
    n, size = bounded.agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0)) * 8).first()
    order = ("width", F.desc("need"), "id")
    ordered = bounded.repartitionByRange(max(1, -(-n // QUERY_BLOCK), -(-size // QUERY_BYTES)), *order).sortWithinPartitions(*order)
    blocks = scratch.write(_pack(ordered, QUERY_BLOCK, QUERY_BYTES), "queries")
    names = {c: f"q_{c}" for c in ("block", "ids", "vectors", "bounds", "need")}
    blocks = blocks.select("width", *[F.col(c).alias(x) for c, x in names.items()])

    # lengths fall from part to part of a width: GROUPS maxima say which parts a block can need
    can = F.col("longest") >= F.col("q_need") * (1 - 1e-9)
    group = F.floor(F.col("part") / -(-parts // GROUPS))
    groups = packed.groupBy("width", group.alias("group")).agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("longest").alias("longest"))
    meets = blocks.select("width", "q_block", "q_need").join(groups, "width").where(can).drop("longest")
    meets = meets.select("width", "q_block", "q_need", F.explode(F.sequence("low", "high")).alias("part"))
    meets = meets.join(packed.select("part", "width", "block", "longest"), ["part", "width"]).where(can).select("q_block", "block")
    pairs = meets.join(blocks.select("q_block", "q_ids", "q_vectors", "q_bounds"), "q_block").join(packed.select("block", "ids", "vectors"), "block")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    # a task gives k rows a query at most; they meet in two steps, so that no task takes the rows of all
    salt = F.pmod(F.spark_partition_id(), F.lit(max(1, round(parts**0.5))))
    for keys in (["query_id", "salt"], ["query_id"]):
        found = found.withColumn("salt", salt) if "salt" in keys else found
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
