"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance.

Search. A fingerprint is embedded as the bit counts of its 16 four-bit segments. The Manhattan
distance of two such points is a lower bound of the Hamming distance. Two lattice points at
distance 2 or less have a lattice point at distance 1 or less of both, so each fingerprint is
put into its own grid cell and the 32 next to it: whatever is within range meets in a cell.
Fingerprints that meet no other one are done; most are.

Verification. What meets is held against the exact distance in the same way one level down:
each fingerprint names the words at Hamming distance 1 or less whose bit counts are those of
the shared cell. Two fingerprints name a common word exactly if 2 or fewer bits differ. All
that name a word are linked to the smallest of them, so a crowded place gives a star and never
all its pairs, and components are the same as with every pair. Each link is checked once more
by its bit count.

Equal fingerprints (exact copies among them) are one node, found by a grouped minimum with
partial aggregation; a large group of copies is never gathered.

Defined results: null or blank text has fingerprint zero and is linked like any other; fewer
words than a shingle: the whole sequence is the shingle; repeated rows share a component; a
null doc_id takes part but never names a component (a component of null ids only is null); an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import connected_components
from ..plans.storage import Scratch, unused

SEED = 42
#: Hashes held at a time.
SLICE_HASHES = 2_000_000


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of the space-joined shingles of a text's words, A-Z lower-cased."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    joined = b" ".join(words)
    if len(words) <= width:
        return [digest(joined, SEED)] if words else []
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends + 1 - size
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text (counts: its number of hashes) the word whose bit is 1 where over half the hashes have it.

    Eight bits are summed at a time, one in each byte of a word, over runs of at most 255."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    runs = -(-n // 255)
    lead = np.repeat(np.cumsum(n) - n, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    texts = np.cumsum(runs) - runs
    low = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & low, lead)
        per_byte = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), texts, axis=0)
        for byte in range(8):
            out[full] |= (2 * per_byte[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _of_texts(texts: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints of a batch of texts, as signed longs."""
    found, counts, held = [], [], []
    for text in texts.cast(pa.binary()):
        h = shingle_hashes(text.as_py() or b"", shingle)
        found.extend(h)
        counts.append(len(h))
        if len(found) > SLICE_HASHES:
            held.append(majority_bits(np.array(found, np.uint64), np.array(counts)))
            found, counts = [], []
    held.append(majority_bits(np.array(found, np.uint64), np.array(counts, np.int64)))
    return np.concatenate(held).view(np.int64)


def fingerprint_of(shingle: int = 3):
    """A column function: the fingerprint of a text, as a long."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(_of_texts(texts, shingle))

    return fp


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) for every row; a map over partitions."""
    return df.select(id_col, fingerprint_of(shingle)(F.col(text_col).cast("string")).alias("fp"))


def _segment_counts(fp: F.Column) -> F.Column:
    """Bit counts of the 16 four-bit segments, each in its own four bits of a long."""

    def half(x):
        pairs = x.bitwiseAND(0x55555555) + F.shiftrightunsigned(x, 1).bitwiseAND(0x55555555)
        return pairs.bitwiseAND(0x33333333) + F.shiftrightunsigned(pairs, 2).bitwiseAND(0x33333333)

    return F.shiftleft(half(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(half(fp.bitwiseAND(0xFFFFFFFF)))


def _cells(fps: DataFrame) -> DataFrame:
    """(fp, cell): the grid cells at Manhattan distance 1 or less."""
    near = [F.col("at")]
    for s in range(16):
        count, unit = F.shiftrightunsigned("at", 4 * s).bitwiseAND(7), F.lit(1 << (4 * s)).cast("long")
        near += [F.when(count < 4, F.col("at") + unit), F.when(count > 0, F.col("at") - unit)]
    return fps.select("fp", _segment_counts(F.col("fp")).alias("at")).select("fp", F.explode(F.array_compact(F.array(*near))).alias("cell"))


def _midpoints(cells: DataFrame) -> DataFrame:
    """(fp, word): words at Hamming distance 1 or less whose segment counts are the cell's."""
    step = F.col("cell") - _segment_counts(F.col("fp"))
    placed = cells.select("fp", step.alias("step"), F.bit_count(F.abs(step) - 1).alias("shift"))
    flips = []
    for k in range(4):
        bit = F.expr(f"shiftleft(1L, shift + {k})")
        is_set = F.col("fp").bitwiseAND(bit) != 0
        flips.append(F.when(is_set == (F.col("step") < 0), F.col("fp").bitwiseXOR(bit)))
    words = F.when(F.col("step") == 0, F.array("fp")).otherwise(F.array_compact(F.array(*flips)))
    return placed.select("fp", F.explode(words).alias("word"))


def _met(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key another fingerprint has too, with the smallest fingerprint there (hub): one shuffle and sort."""
    same = Window.partitionBy(key)
    return rows.withColumns({"hub": F.min("fp").over(same), "most": F.max("fp").over(same)}).where("hub < most").drop("most")


def links(fps: DataFrame) -> DataFrame:
    """(fp, hub): stars over distinct fingerprints; same components as all pairs within 2 bits."""
    words = _midpoints(_met(_cells(fps), "cell").select("fp", "cell"))
    stars = _met(words, "word").where("fp <> hub").select("fp", "hub").distinct()
    return stars.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= 2)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long, component_id): component_id is the smallest id linked, over any number of steps."""
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.write(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    fps = scratch.write(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    parts = connected_components(links(fps), "fp", "hub")
    member = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    member = scratch.write(member.select("fp", "part", "least"), "members")
    named = member.groupBy("part").agg(F.min("least").alias("component_id"))
    by_fp = member.join(named, "part").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """df's columns of one row of each group: that with the smallest id (null ids last, then any one of equals).

    The row is chosen by fingerprint first, with partial aggregation, so a large group of copies is
    never joined or gathered; only the rows that go are then looked up."""
    scratch = Scratch(df.sparkSession, "simhash")
    fp, row = unused(df, "__fp"), unused(df, "__row")
    made = fingerprint_of(shingle)(F.col(text_col).cast("string"))
    rows = scratch.write(df.select(*df.columns, made.alias(fp), F.monotonically_increasing_id().alias(row)), "rows")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    fps = scratch.write(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("best")), "distinct")
    parts = connected_components(links(fps), "fp", "hub")
    best = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("component", "fp").alias("part")).agg(F.min("best").alias("best"))
    return rows.join(best.select(F.col("best.row").alias(row)), row, "left_semi").select(*df.columns)


def as_hex(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
