"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Text is cut into words (a run of spaces and what follows up to the next space). Each distinct
word is encoded once per task cache. All new words of a batch lie in one flat numpy array of
symbols; a round looks up the rank of every neighbouring pair, takes the minimum per segment,
merges its leftmost non-overlapping occurrences in all segments at once and compacts the
arrays, until no segment has a pair left.

Exactness. The library merges the best pair first, leftmost on ties. Merging all occurrences
of the best rank at once is the same unless a merge can create a pair that ranks at least as
high as the merged piece; pieces for which the vocabulary allows that are known beforehand
("unsettled"), and a segment whose best pair yields one merges only its leftmost occurrence.
A segment ends where two neighbouring characters stand together in no piece, as no merge can
cross that place; so long texts without spaces fall apart as well.

The model goes to tasks as its bytes, so executors need no file. A model whose normaliser or way of
splitting is not the one above (identity, a space put in front, split at spaces only) is turned down: the
driver encodes PROBES with it and with the library before anything runs.

Defined results: null text counts as empty (no ids, empty decoded text); very long texts and
words are encoded whole; repeated rows are encoded alike; an empty table gives an empty table;
other columns are not read by the operator.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice, pairwise
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Texts on which normalisers and ways of splitting differ.
PROBES = ("", " ", "  two  spaces ", "ﬁ Ａ① ½ e\u0301 İ", "CamelCase UPPER", "year 1999-2024, 3.14", "a\tb\nc\r\n", "日本語テキスト 한국어", "▁x▁▁y", "x\u00a0y\u3000z\u200b", "\x00\x7f😀𝔘", "don't (stop)!")
#: Words kept in a task's cache; beyond it the cache is emptied (about 150 MB).
CACHE_WORDS = 700_000
#: Characters encoded at a time.
SLICE_CHARS = 2_000_000


class Vocabulary:
    """Tables of a BPE model with byte fallback, read through the library's own loader."""

    def __init__(self, model: bytes | str):
        """model: the bytes of a model file, or its place."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.size = n
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes_of.append(b"" if special[i] else p.replace(SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError("only models with byte fallback are supported")
        ids = {p: i for i, p in enumerate(pieces) if not special[i] and not sp.is_byte(i)}
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.single = np.full(0x110000, -1, np.int64)
        glyphs = sorted({c for p in ids if len(p) > 1 for c in p})
        self.glyph = np.zeros(0x110000, np.int32)
        for k, c in enumerate(glyphs, 1):
            self.glyph[ord(c)] = k
        self.together = np.zeros((len(glyphs) + 1,) * 2, bool)
        keys, merged = [], []
        self.unsettled = np.zeros(n, bool)
        for p, i in ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
                continue
            at = self.glyph[[ord(c) for c in p]]
            self.together[at[:-1], at[1:]] = True
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is None or b is None:
                    continue
                keys.append(a * n + b)
                merged.append(i)
                for part in (a, b):
                    self.unsettled[part] |= self.rank[part] >= self.rank[i]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, and how many each has. A word's first space is left out ("ab" is " ab")."""
        text = "".join(SPACE + w.replace(" ", SPACE) for w in words)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        sym, pos = self.single[cp], np.arange(len(cp))
        cut = np.zeros(len(cp), bool)
        cut[np.cumsum(size) - size] = True
        glyph = self.glyph[cp]
        cut[1:] |= ~self.together[glyph[:-1], glyph[1:]]
        at, symbols = self._merge(pos, sym, np.cumsum(cut) - 1)
        order = np.argsort(at)
        at, symbols = at[order], symbols[order]
        counts, missing = np.ones(len(at), np.int64), np.flatnonzero(symbols < 0)
        if len(missing):
            raw = [chr(c).encode("utf-8", "replace") for c in cp[at[missing]]]
            counts[missing] = [len(b) for b in raw]
            out = np.repeat(symbols, counts)
            out[out < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            out = symbols
        starts = np.cumsum(size) - size
        word = np.searchsorted(starts, at, "right") - 1
        return out, np.bincount(word, counts, len(words)).astype(np.int64)

    def _merge(self, pos: np.ndarray, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        never = np.int64(1) << 40
        done_pos, done_sym = [], []
        while len(pos):
            key = np.where((seg[:-1] == seg[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0), sym[:-1] * self.size + sym[1:], -1)
            hit = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            ok = self.pair_keys[hit] == key
            made = np.append(np.where(ok, self.pair_ids[hit], 0), 0)
            rank = np.append(np.where(ok, self.rank[made[:-1]], never), never)
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            width = np.diff(np.append(first, len(seg)))
            best = np.minimum.reduceat(rank, first)
            live = np.repeat(best < never, width)
            if not live.all():
                done_pos.append(pos[~live])
                done_sym.append(sym[~live])
                pos, sym, seg, made, rank = pos[live], sym[live], seg[live], made[live], rank[live]
                width, best = width[best < never], best[best < never]
                if not len(pos):
                    break
            top = rank == np.repeat(best, width)
            # leftmost, not overlapping: every other one of a run
            index = np.arange(len(top))
            run = np.maximum.accumulate(np.where(top & ~np.append(False, top[:-1]), index, -1))
            take = top & ((index - run) % 2 == 0)
            unsettled = np.flatnonzero(take & self.unsettled[made])
            if len(unsettled):
                part = np.repeat(np.arange(len(width)), width)
                at = np.flatnonzero(take)
                lead = at[np.append(True, part[at[1:]] != part[at[:-1]])]
                single = np.zeros(len(width), bool)
                single[part[unsettled]] = True
                take &= ~single[part]
                take[lead] = True
            sym = np.where(take, made, sym)
            keep = ~np.append(False, take[:-1])
            pos, sym, seg = pos[keep], sym[keep], seg[keep]
        if not done_pos:
            return pos, sym
        return np.concatenate(done_pos), np.concatenate(done_sym)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.text([self.bytes_of[i] for i in ids])

    @staticmethod
    def text(pieces: list[bytes]) -> str:
        text = b"".join(pieces)
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


class Encoder:
    """A vocabulary with a bounded cache of words."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self.v, self.cache_words = vocabulary, cache_words
        self._clear()

    def _clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)  # a new word gets the next number
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, new: list[str]) -> None:
        ids, n = self.v.encode_words(new)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start = np.append(self.start, self.used + np.cumsum(n) - n)
        self.length = np.append(self.length, n)
        self.used += len(ids)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids, number of ids per text, decoded texts."""
        cut = [_words(t) for t in texts]
        if len(self.number) > self.cache_words:
            self._clear()
        old, n_words = len(self.number), np.fromiter(map(len, cut), np.int64, len(cut))
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, n_words.sum())
        if len(self.number) > old:
            self._add(list(islice(self.number, old, None)))
        size = self.length[word]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[word] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        to = np.append(0, ends)[np.append(0, np.cumsum(n_words))]
        pieces = list(map(self.v.bytes_of.__getitem__, ids.tolist()))
        decoded = [self.v.text(pieces[a:b]) for a, b in pairwise(to.tolist())]
        return ids, np.diff(to), decoded


def _words(text: str) -> list[str]:
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ")


def model_bytes(model_file: str) -> bytes:
    """The model, read on the driver. Raises ValueError if this encoder would not give the library's ids."""
    import sentencepiece

    data = Path(model_file).read_bytes()
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=data), Encoder(Vocabulary(data))
    for probe in PROBES:
        ids, _, decoded = own([probe])
        if sp.encode(probe) != ids.tolist() or sp.decode(sp.encode(probe)) != decoded[0]:
            raise ValueError(f"{model_file}: its normaliser or way of splitting is not supported ({probe!r} is encoded otherwise)")
    return data


def sentencepiece_encode(
    df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """(id_col, ids array<int>, decoded string) for every row: a map over partitions, without a shuffle."""
    kind, model = dict(df.dtypes)[id_col], df.sparkSession.sparkContext.broadcast(model_bytes(model_file))  # under 1 MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(model.value))
            lengths = np.cumsum(np.asarray(pa.compute.utf8_length(batch.column(1)).fill_null(0)))
            at = 0
            while at < batch.num_rows:
                done = lengths[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(lengths, done + slice_chars, "right")))
                part = batch.slice(at, to - at)
                ids, n, decoded = encoder([t or "" for t in part.column(1).to_pylist()])
                offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])
                at = to

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def sentencepiece_decode(df: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; null ids give null."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(model_file))

    @F.pandas_udf("string")
    def text_of(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(model.value)
        for ids in chunks:
            yield ids.map(lambda x: None if x is None else v.decode(x))

    return df.withColumn(out_col, text_of(ids_col))


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of sentencepiece_encode's rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
