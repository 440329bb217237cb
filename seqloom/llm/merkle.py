"""Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over the groups, a proof for each leaf.

A run of two nodes (the last one of a level may be single) becomes their hash, until one node remains. Leaves of a
group are cut into aligned blocks of a power of two, so that a block's root is a node of the group's tree. Blocks of a
few thousand nodes together go to a task as Arrow tables, where DuckDB climbs them level by level, each level one
query of ordered string_agg and sha256. Blocks' roots are the nodes of the next round, which Spark deals out in
the same way, until each group has one root; the groups' roots are one more such tree. Then the rounds are run
downwards: a node's proof is what DuckDB finds in its block, followed by the proof of the block's root, which Spark
brings to the same task by a cogroup on the blocks' pack. Only hashes move, never the rows; a pack has a bounded
number of nodes in expectation whatever the groups' sizes; the driver sees counts and the one root.

Defined results: a null value is `-` in a leaf, an empty text `0:`; a null group is one group and comes first; null
ids come first in theirs; rows with one id are leaves each, ordered by their hash, and equal rows are interchangeable;
texts of any length are hashed whole; a group of one leaf has it as its root, and one group's root is the root; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch
from .places import places

HEIGHT, PACK = 10, 4096
PROOF = "array<struct<sibling:string,on_left:boolean>>"
_PROOF = pa.list_(pa.struct([("sibling", pa.string()), ("on_left", pa.bool_())]))
_ROOTS = "grp string, block long, h string"


def leaf_hash(values: list[F.Column]) -> F.Column:
    """Hex SHA-256 of the values in a row, each as its length in bytes, a colon and its text, or `-` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _engine():
    """A DuckDB of this task's own, in memory: one thread, no files."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": "", "max_temp_directory_size": "0B"})


def _climb(con, nodes: pa.Table) -> int:
    """Tables level_0, level_1, ...: nodes (grp, block, pos, h, height) of each level with what the run that made each
    one held (lefts, rights); the number of the last level."""
    con.register("nodes", nodes)
    con.execute("CREATE TABLE level_0 AS SELECT grp, block, pos, h, height, NULL::VARCHAR AS lefts, NULL::VARCHAR AS rights FROM nodes")
    top = con.execute("SELECT coalesce(max(height), 0) FROM level_0").fetchall()[0][0]
    for k in range(top):
        con.execute(
            f"""CREATE TABLE level_{k + 1} AS
            SELECT grp, block, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, height,
              max(h) FILTER (pos % 2 = 0) AS lefts, max(h) FILTER (pos % 2 = 1) AS rights
            FROM level_{k} WHERE height > {k} GROUP BY grp, block, pos // 2, height"""
        )
    return top


def _block_roots(nodes: pa.Table) -> pa.Table:
    with _engine() as con:
        top = _climb(con, nodes)
        every = " UNION ALL ".join(f"SELECT grp, block, h FROM level_{k} WHERE height = {k}" for k in range(top + 1))
        return con.sql(every).to_arrow_table().cast(pa.schema([("grp", pa.string()), ("block", pa.int64()), ("h", pa.string())]))


def _block_proofs(carried: list[str], height: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def proofs(nodes: pa.Table, above: pa.Table) -> pa.Table:
        schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("h", pa.string()), *[nodes.schema.field(c) for c in carried], ("subroot", pa.string()), ("proof", _PROOF)])
        with _engine() as con:
            top = _climb(con, nodes)
            con.register("above", above)
            con.execute(f"CREATE TABLE down_{top + 1} (grp VARCHAR, block BIGINT, pos BIGINT, subroot VARCHAR, proof STRUCT(sibling VARCHAR, on_left BOOLEAN)[])")
            for k in range(top, -1, -1):
                con.execute(
                    f"""CREATE TABLE down_{k} AS
                    SELECT n.grp, n.block, n.pos, p.subroot, list_prepend({{'sibling': CASE WHEN n.pos % 2 = 0 THEN r.rights ELSE r.lefts END, 'on_left': n.pos % 2 = 1}}, p.proof) AS proof
                    FROM level_{k} n JOIN down_{k + 1} p ON p.grp = n.grp AND p.block = n.block AND p.pos = n.pos // 2
                    JOIN level_{min(k + 1, top)} r ON r.grp = n.grp AND r.block = n.block AND r.pos = n.pos // 2
                    WHERE n.height > {k}
                    UNION ALL SELECT n.grp, n.block, n.pos, a.subroot, a.proof FROM level_{k} n JOIN above a ON a.grp = n.grp AND a.block = n.block WHERE n.height = {k}"""
                )
            names = ", ".join(["n.grp", f"n.block * {2**height} + n.pos AS pos", "n.h", *[f'n."{c}"' for c in carried], "d.subroot", "d.proof"])
            found = con.sql(f"SELECT {names} FROM nodes n JOIN down_0 d ON d.grp = n.grp AND d.block = n.block AND d.pos = n.pos").to_arrow_table()
        return found.cast(schema)

    return proofs


def _packed(nodes: DataFrame, packs: int) -> DataFrame:
    return nodes.withColumn("pack", F.pmod(F.xxhash64("grp", "block"), F.lit(packs)))


class _Round:
    """Nodes (grp, pos, h, ...) of every group that has not come to one node yet, and what their blocks give."""

    def __init__(self, nodes: DataFrame, height: int, pack: int, scratch: Scratch, name: str):
        self.height, wide = height, 2**height
        size = F.count("*").alias("n")
        counts = scratch.write(nodes.groupBy("grp").agg(size), f"{name}-counts")
        self.total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.packs = max(1, -(-self.total // pack))
        levels = F.when(F.col("n") > wide, height).otherwise(F.ceil(F.log2("n"))).cast("int")
        rows = nodes.join(counts, "grp").withColumns({"height": levels, "block": F.expr(f"pos div {wide}"), "pos": F.col("pos") % wide})
        self.nodes = _packed(rows, self.packs)
        self.more = counts.where(F.col("n") > wide)
        roots = self.nodes.select("pack", "grp", "block", "pos", "h", "height").groupBy("pack").applyInArrow(_block_roots, _ROOTS)
        self.roots = scratch.write(roots.join(self.more.select("grp", F.lit(True).alias("goes_on")), "grp", "left"), f"{name}-roots")

    def ended(self) -> DataFrame:
        return self.roots.where("goes_on IS NULL").select("grp", "h")

    def onward(self) -> DataFrame:
        return self.roots.where("goes_on").select("grp", F.col("block").alias("pos"), "h")


def _climbed(nodes: DataFrame, height: int, pack: int, scratch: Scratch, name: str) -> tuple[list[_Round], DataFrame]:
    """The rounds, and (grp, h): the root of each group."""
    rounds = [_Round(nodes, height, pack, scratch, f"{name}-0")]
    roots = rounds[0].ended()
    while rounds[-1].more.limit(1).count():
        rounds.append(_Round(rounds[-1].onward(), height, pack, scratch, f"{name}-{len(rounds)}"))
        roots = roots.unionByName(rounds[-1].ended())
    return rounds, roots


def _descended(rounds: list[_Round], tops: DataFrame, carried: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(grp, pos, h, carried, subroot, proof) of the first round's nodes. tops: (grp, subroot, proof) of each group."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        here, keep = rounds[k], [] if k else carried
        last = here.ended().join(tops, "grp").select("grp", F.lit(0).cast("long").alias("block"), "subroot", "proof")
        over = last if above is None else last.unionByName(above.select("grp", F.col("pos").alias("block"), "subroot", "proof"))
        types = {f.name: f.dataType.simpleString() for f in here.nodes.schema}
        schema = ", ".join(["grp string", "pos long", "h string", *[f"`{c}` {types[c]}" for c in keep], "subroot string", f"proof {PROOF}"])
        nodes = here.nodes.select("pack", "grp", "block", "pos", "h", "height", *keep)
        above = nodes.groupBy("pack").cogroup(_packed(over, here.packs).groupBy("pack")).applyInArrow(_block_proofs(keep, here.height), schema)
        if k:
            above = scratch.write(above, f"{name}-proofs-{k}")
    return above


def manifest(
    df: DataFrame, id_col: str, group_col: str, columns: list[str], claims: dict[str, F.Column] | None = None, height: int = HEIGHT, pack: int = PACK
) -> DataFrame:
    """(id_col, leaf, claimed, subroot, root, proof) of every row of df. A leaf is the hash of `columns`. `claims` gives
    values that someone claims for some columns; claimed is the leaf of the row with them, null where it is the same.
    Blocks have 2**height leaves, a task about `pack` of them. proof: for each level from the leaf to the root, the sibling's hash (null: the node is alone) and its side."""
    scratch = Scratch(df.sparkSession, "merkle")
    values = {c: F.col(f"`{c}`") for c in columns}
    leaf, claimed = leaf_hash(list(values.values())), leaf_hash(list((values | (claims or {})).values()))
    # where no claim differs, the text is not hashed a second time
    differs = F.lit(False)
    for c, claim in (claims or {}).items():
        differs |= ~claim.cast("string").eqNullSafe(values[c].cast("string"))
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    leaves = df.select(key.alias("grp"), F.col(f"`{id_col}`").alias("id"), leaf.alias("h"), F.when(differs, claimed).alias("claimed"))
    leaves = places(leaves, ["grp"], ["id", "h"], scratch, "leaves").withColumnRenamed("place", "pos")
    leaves = scratch.write(leaves, "nodes")
    rounds, subroots = _climbed(leaves, height, pack, scratch, "groups")
    groups = scratch.write(subroots.withColumnRenamed("grp", "name"), "subroots")
    ranked = places(groups, [], ["name"], scratch, "ranked").select(F.lit("").alias("grp"), F.col("place").alias("pos"), "h", "name")
    upper, roots = _climbed(scratch.write(ranked, "top"), height, pack, scratch, "top")
    root = roots.first()
    root = root.h if root else None
    top = roots.select("grp", F.col("h").alias("subroot"), F.array().cast(PROOF).alias("proof"))
    tops = _descended(upper, top, ["name"], scratch, "top").select(F.col("name").alias("grp"), F.col("h").alias("subroot"), "proof")
    rows = _descended(rounds, scratch.write(tops, "tops"), ["id", "claimed"], scratch, "groups")
    return rows.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "claimed", "subroot", F.lit(root).alias("root"), "proof")


def folded(leaf: F.Column, proof: F.Column) -> F.Column:
    """The root that a leaf and its proof give."""

    def step(node: F.Column, at: F.Column) -> F.Column:
        left = F.when(at["on_left"], at["sibling"])
        right = F.when(~at["on_left"], at["sibling"])
        return F.sha2(F.concat(F.coalesce(left, F.lit("")), node, F.coalesce(right, F.lit(""))), 256)

    return F.aggregate(proof, leaf, step)


def verified(rows: DataFrame) -> DataFrame:
    """A manifest's rows with folded_root, from the claimed leaf if there is one, and verified."""
    rows = rows.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Verified rows with the digest of each proof's siblings in place of the proof."""
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: s["sibling"]), ""), 256)
    return rows.select(id_col, "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


#: CRC-32 in SQL: the table by its rule, then a fold over the bytes of a decimal number.
CRC32 = """crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b))"""
CRC32_OF = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(t[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8)), 4294967295)"

_VALUE = "coalesce(strlen({0}) || ':' || {0}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_VALUE.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


SQL = f"""
WITH RECURSIVE {CRC32}, leaf AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + CASE WHEN " + CRC32_OF.format("CAST(doc_id AS VARCHAR)") + " % 7 = 0 THEN 1 ELSE 0 END")} AS claimed
  FROM documents, crc_table
), numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, coalesce('=' || lang, '') AS grp FROM leaf
), node AS (
  SELECT grp, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM numbered
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM node WHERE n > 1 GROUP BY grp, level, pos // 2
), subroot AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos FROM node WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM upper WHERE n > 1 GROUP BY level, pos // 2
), height AS (SELECT grp, max(level) AS height FROM node GROUP BY grp
), step AS (
  SELECT l.grp, l.pos, n.level, (l.pos >> n.level) % 2 = 1 AS on_left, s.h AS sibling
  FROM numbered l JOIN node n ON n.grp = l.grp AND n.pos = l.pos >> n.level AND n.n > 1
  LEFT JOIN node s ON s.grp = n.grp AND s.level = n.level AND s.pos = xor(n.pos, 1)
  UNION ALL
  SELECT l.grp, l.pos, t.height + n.level, (r.pos >> n.level) % 2 = 1, s.h
  FROM numbered l JOIN height t ON t.grp = l.grp JOIN subroot r ON r.grp = l.grp JOIN upper n ON n.pos = r.pos >> n.level AND n.n > 1
  LEFT JOIN upper s ON s.level = n.level AND s.pos = xor(n.pos, 1)
), proof AS (
  SELECT grp, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256, list({{'level': level, 'on_left': on_left, 'sibling': sibling}} ORDER BY level) AS steps
  FROM step GROUP BY grp, pos
), fold AS (
  SELECT l.grp, l.pos, 0 AS k, l.claimed AS h, p.steps FROM numbered l LEFT JOIN proof p ON p.grp = l.grp AND p.pos = l.pos
  UNION ALL
  SELECT grp, pos, k + 1, sha256(CASE WHEN steps[k + 1].on_left THEN coalesce(steps[k + 1].sibling, '') ELSE '' END || h || CASE WHEN steps[k + 1].on_left THEN '' ELSE coalesce(steps[k + 1].sibling, '') END), steps
  FROM fold WHERE k < coalesce(len(steps), 0)
)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM numbered l JOIN subroot s ON s.grp = l.grp JOIN (SELECT h FROM upper WHERE n = 1) r ON true
LEFT JOIN proof p ON p.grp = l.grp AND p.pos = l.pos JOIN fold f ON f.grp = l.grp AND f.pos = l.pos AND f.k = coalesce(len(f.steps), 0)
"""
