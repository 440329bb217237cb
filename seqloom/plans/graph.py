"""Connected components by alternating large and small stars.

Each round rewires every edge towards the smallest neighbour, so a component of any diameter becomes a
star in a logarithmic number of rounds. All state stays in DataFrames; each step is written to the
shared folder, which cuts its lineage, and is deleted when the next one stands.

The smallest neighbour is a grouped minimum with partial aggregation. It comes back to the edges by a
join of two written tables: Spark broadcasts the minima while they are under its size threshold, and
beyond it splits the edges of a hub over tasks as a skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _stars(pairs: DataFrame, larger_only: bool, scratch: Scratch, name: str) -> DataFrame:
    """(u, v): v is a neighbour of u. Link u's neighbours (and u) to the smallest of them."""
    least = scratch.write(pairs.groupBy("u").agg(F.least(F.min("v"), "u").alias("m")), f"{name}-least")
    linked = pairs.join(least, "u")
    if larger_only:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return scratch.write(out.where("a <> b").distinct(), name)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge to
    another node are not returned; null ends and self loops are ignored; parallel edges count once;
    no edges give an empty table."""
    scratch = Scratch(edges.sparkSession, "components")
    ends = F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")
    cur = scratch.write(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(*ends).distinct(), "0")

    def state() -> tuple:
        return tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state()
    for k in range(max_rounds if seen[0] else 0):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = _stars(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), True, scratch, f"{k}-large")
        cur = _stars(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False, scratch, f"{k + 1}")
        for old in (f"{k}", f"{k}-large", f"{k}-large-least", f"{k + 1}-least"):
            scratch.drop(old)
        before, seen = seen, state()
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
