"""Removal of repeated windows of words, with a count-min prefilter.

Documents are packed once into blocks of a few MB (one row each) in a table bucketed by block,
so later joins bring small answers to the blocks and never move the texts again.

1. Sketch. A window stands for its anchor: of the runs of words that it is made of (GRAM words
   each), the one with the least hash, leftmost of equals. Equal windows have equal anchors at equal
   places, so a window occurs at most as often as its anchor, and neighbouring windows share one: a
   sketch of anchors overestimates windows and has about a seventh of the entries. Every block makes
   a count-min sketch of its anchors, DEPTH rows of hashed cells, as rows (cell, count up to two) of
   the cells that are not zero. Sketches are merged by adding the counts of a cell, in Spark; a block
   gets back its cells that are counted twice or more. The width grows with the corpus (CELLS cells a
   window), so the share of overestimates stays the same at every size.
2. Exact grouping. A window whose anchor's cells are all counted twice or more may be repeated; the
   others can't be. Of the former, each block sends every distinct one once, with its first place:
   its key is a 128-bit keyed BLAKE2 digest of its words (the key is drawn for each run, so no text
   can aim at a collision), and Spark finds each key's first place. A block hears which of its windows
   start earlier elsewhere; within a block, later places of a key are found locally. As a block sends
   a key or a cell once, a passage that stands in every document costs one row a block.
3. Removal. Words covered by a window that starts earlier elsewhere go.

Defined results: null or blank text has no words; a text shorter than a window loses nothing; a very
long text is a block of its own and is searched whole; of equal windows the first place stays, places
being compared by (doc_id, word number), so rows with equal doc_id and text are one and the same place
and neither is later; a null doc_id stands before all others; white space in the kept text is a
single space; an empty table gives an empty table; other columns are not read. Ids are
integers of at most 64 bits and come back in their own type.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import Scratch

WINDOW = 20
#: Bytes of text in a block.
BLOCK_BYTES = 4_000_000
#: Rows of the sketch, and cells a window in each.
DEPTH, CELLS = 2, 16

_U = np.uint64
_MIX = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _MIX[0]
    x = (x ^ (x >> _U(29))) * _MIX[1]
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, by doubling."""
    out, have = np.ones(max(n, 1), np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, from sums of byte values times powers: no Python object per word.
    Different words may share one; the sketch then overestimates."""
    sums = np.append(_U(0), np.cumsum(_BYTE_VALUES[data] * _powers(_BASE, len(data))))
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def anchors(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of `width` word hashes: where its anchor begins; and the hash of the run of words at every place."""
    gram = max(1, 2 * width // 5)
    runs = words[: len(words) - gram + 1].copy()
    for k in range(1, gram):
        runs = _mix(runs * _U(_BASE) + words[k : len(words) - gram + 1 + k])
    # the least of n runs: high bits of the hash, then the place, so that of equals the leftmost is least
    place_bits = _U(max(1, len(runs).bit_length()))
    least, span, n = (runs >> place_bits << place_bits) | np.arange(len(runs), dtype=np.uint64), 1, width - gram + 1
    while 2 * span <= n:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if n > span:
        least = np.minimum(least[: len(least) - (n - span)], least[n - span :])
    return (least & ((_U(1) << place_bits) - _U(1))).astype(np.int64), runs


class Block:
    """Words and windows of a block's documents, which stand in order of their ids."""

    def __init__(self, ids: list, texts: list, width: int):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
        self.width, self.ids = width, [ids[k] for k in order]
        self.texts = [texts[k] for k in order]  # words joined by single spaces
        self.joined = b" ".join(t for t in self.texts if t) + b" "
        data = np.frombuffer(self.joined, np.uint8)
        self.ends = np.flatnonzero(data == 32) if len(data) > 1 else np.empty(0, np.int64)
        self.starts = np.append(0, self.ends[:-1] + 1) if len(self.ends) else self.ends
        self.n_words = np.array([t.count(b" ") + 1 if t else 0 for t in self.texts], np.int64)
        self.first = np.cumsum(self.n_words) - self.n_words
        self.doc = np.repeat(np.arange(len(self.ids)), self.n_words)
        n = max(0, len(self.starts) - width + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :][:n]) if n else np.empty(0, np.int64)
        if len(self.at):
            place, runs = anchors(word_hashes(data, self.starts, self.ends), width)
            place = place[self.at]
            # anchors follow one another, so equal places stand together
            new = np.append(True, place[1:] != place[:-1])
            self.anchor, self.anchor_of = runs[place[new]], np.cumsum(new) - 1
        else:
            self.anchor, self.anchor_of = np.empty(0, np.uint64), self.at

    def cells(self, row: int, bits: int) -> np.ndarray:
        """Cell of each anchor in a row of the sketch; rows follow one another."""
        return ((_mix(self.anchor + _U(row) * _U(_BASE)) >> _U(64 - bits)) | (_U(row) << _U(bits))).astype(np.int64)

    def suspects(self, full: np.ndarray, depth: int, bits: int) -> np.ndarray:
        """Places among the windows of those whose anchor's cells are all in `full`."""
        maybe = np.ones(len(self.anchor), bool)
        for row in range(depth):
            maybe &= np.isin(self.cells(row, bits), full)
        return np.flatnonzero(maybe[self.anchor_of]) if len(self.at) else self.at

    def digests(self, some: np.ndarray, key: bytes) -> np.ndarray:
        """(n, 2) keyed digests of windows' words."""
        begin, end = self.starts[self.at[some]].tolist(), self.ends[self.at[some] + self.width - 1].tolist()
        joined, blank = self.joined, blake2b(key=key, digest_size=16)
        out = []
        for a, b in zip(begin, end, strict=True):
            h = blank.copy()
            h.update(joined[a:b])
            out.append(h.digest())
        return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)

    def groups(self, some: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows `some`: digests, and first places of each distinct one (in order) with every window's group."""
        made = self.digests(some, key)
        order = np.lexsort((some, made[:, 1], made[:, 0]))
        new = np.append(True, (made[order][1:] != made[order][:-1]).any(axis=1))[: len(order)]
        heads = order[new]
        rank = np.empty(len(heads), np.int64)
        rank[np.argsort(heads)] = np.arange(len(heads))
        group = np.empty(len(some), np.int64)
        group[order] = rank[np.cumsum(new) - 1]
        return made, np.sort(heads), group

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window the doc_id (null as the least value) and the number of its first word."""
        least = np.iinfo(np.int64).min
        ids = np.array([least if x is None else x for x in self.ids], np.int64)
        doc = self.doc[self.at]
        return ids[doc], self.at - self.first[doc]


def _blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, ids, texts, n_words): words of a text joined by single spaces."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary())), ("n_words", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size, n_words = [], [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, ids, texts, n_words), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()  # of bytes: at ASCII white space
                if ids and size + len(text.as_py() or b"") > block_bytes:
                    yield row()
                    number, ids, texts, size, n_words = number + 1, [], [], 0, 0
                ids.append(i)
                texts.append(b" ".join(words))
                size += len(texts[-1])
                n_words += len(words)
        if ids:
            yield row()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pack, "block long, ids array<long>, texts array<binary>, n_words long")


def _each_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, Block]]:
    """Rows one at a time, lists of numbers as arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {}
            for name in batch.schema.names:
                x = batch.column(name)[k]
                numbers = pa.types.is_list(x.type) and name in ("full", "later")
                row[name] = (np.asarray(x.values) if x.is_valid else np.empty(0, np.int64)) if numbers else x.as_py()
            yield row, Block(row.pop("ids"), row.pop("texts"), width)


def _sketches(blocks: DataFrame, width: int, depth: int, bits: int) -> DataFrame:
    """(cell, block, n): the cells of each block's sketch that are not zero; n is 2 for more."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in _each_block(batches, width):
            for r in range(depth):
                cells, n = np.unique(b.cells(r, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(np.full(len(cells), row["block"])), pa.array(np.minimum(n, 2).astype(np.int8))], ["cell", "block", "n"]
                )

    return blocks.select("block", "ids", "texts").mapInArrow(sketch, "cell long, block long, n byte")


def _suspects(answered: DataFrame, width: int, depth: int, bits: int, key: bytes) -> DataFrame:
    """(k1, k2, block, doc, word, place): each distinct window of a block that may be repeated, at its first place."""

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in _each_block(batches, width):
            some = b.suspects(row["full"], depth, bits)
            if not len(some):
                continue
            made, heads, _ = b.groups(some, key)
            doc, word = b.places()
            w = some[heads]
            columns = (made[heads, 0], made[heads, 1], np.full(len(w), row["block"]), doc[w], word[w].astype(np.int32), w.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "block", "doc", "word", "place"])

    return answered.select("block", "ids", "texts", "full").mapInArrow(suspect, "k1 long, k2 long, block long, doc long, word int, place int")


def _remove(answered: DataFrame, width: int, depth: int, bits: int, key: bytes, id_type: str) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in _each_block(batches, width):
            covered = np.zeros(len(b.doc), bool)
            some = b.suspects(row["full"], depth, bits)
            if len(some):
                _, heads, group = b.groups(some, key)
                doc, word = b.places()
                head = some[heads][group]
                # later than the first place of the block, or that place is later than another block's
                gone = (doc[some] != doc[head]) | (word[some] != word[head]) | np.isin(head, row["later"])
                edge = np.zeros(len(b.doc) + 1, np.int64)
                np.add.at(edge, b.at[some[gone]], 1)
                np.subtract.at(edge, b.at[some[gone]] + width, 1)
                covered = np.cumsum(edge[:-1]) > 0
            n_removed = np.bincount(b.doc[covered], minlength=len(b.ids))
            kept = []
            for k, text in enumerate(b.texts):
                if n_removed[k]:
                    words, stay = text.split(b" "), ~covered[b.first[k] : b.first[k] + b.n_words[k]]
                    text = b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])
                kept.append(text)
            columns = (b.ids, b.n_words.tolist(), n_removed.tolist(), kept)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    out = answered.select("block", "ids", "texts", "full", "later").mapInArrow(remove, "id long, n_words long, n_removed long, kept binary")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumn("kept", F.col("kept").cast("string"))


def remove_repeated_windows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id_col, n_words, n_removed, kept string) for every row."""
    scratch, key = Scratch(df.sparkSession, "substring"), secrets.token_bytes(16)
    buckets = max(1, min(50_000, df.select(text_col).rdd.getNumPartitions()))
    blocks = scratch.write_bucketed(_blocks(df, id_col, text_col, block_bytes), "blocks", buckets, "block")
    n = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = min(61, max(16, int(n * CELLS).bit_length()))

    counted = F.sum("n").over(Window.partitionBy("cell"))
    cells = _sketches(blocks, window, depth, bits).withColumn("n", counted).where("n > 1")
    full = scratch.write(cells.groupBy("block").agg(F.collect_list("cell").alias("full")), "cells")
    answered = blocks.join(full, "block", "left")

    place = F.struct("doc", "word")
    first = F.min(place).over(Window.partitionBy("k1", "k2"))
    found = _suspects(answered, window, depth, bits, key).withColumn("first", first).where(F.col("first") != place)
    later = scratch.write(found.groupBy("block").agg(F.collect_list("place").alias("later")), "later")
    return _remove(answered.join(later, "block", "left"), window, depth, bits, key, dict(df.dtypes)[id_col]).withColumnRenamed("id", id_col)
