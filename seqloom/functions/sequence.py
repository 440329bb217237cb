"""Column functions over nucleotide strings. All of them stay in the JVM; null gives null."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes


def r6(x: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def normalize_name(x: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def split_terms(x: Column, separators: str = "[;,]") -> Column:
    """Trimmed terms between separators, without empty ones."""
    return F.filter(F.transform(F.split(x, separators), lambda t: F.trim(t)), lambda t: t != "")


def to_rna(x: Column) -> Column:
    return F.translate(F.upper(x), "T", "U")


def to_dna(x: Column) -> Column:
    return F.translate(F.upper(x), "U", "T")


def reverse_complement(x: Column) -> Column:
    """Keeps case and N; a string with U is RNA and its T stays as it is."""
    rna = F.translate(x, "AUCGaucg", "UAGCuagc")
    return F.reverse(F.when(F.upper(x).contains("U"), rna).otherwise(F.translate(x, "ATCGatcg", "TAGCtagc")))


def codons(rna: Column) -> Column:
    """Triplets in order; a tail of one or two bases is left out."""
    return F.regexp_extract_all(rna, F.lit("([ACGU]{3})"), F.lit(1))


def codon_index(codon: Column, order: str = codes.BASES) -> Column:
    """0 to 63 by the bases' places in `order`, of what codons() gives; anything else may have any number."""
    at = [F.instr(F.lit(order), F.substring(codon, k, 1)) for k in (1, 2, 3)]
    return at[0] * 16 + at[1] * 4 + at[2] - 21


def _by_table(table: Column | int, per_table: list) -> Column:
    """A table's element; null for ids outside 1..33."""
    values = F.array(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for x in per_table])
    t = F.lit(table) if isinstance(table, int) else table
    return F.when(t.between(1, 33), F.element_at(values, t.cast("int")))


def amino_acid(codon: Column, table: Column | int = 1) -> Column:
    """X for what is no codon; null for a table outside 1..33."""
    letters = _by_table(table, [codes.amino_acids(t) for t in codes.TABLES])
    return F.when(codon.rlike("^[ACGU]{3}$"), F.substring(letters, codon_index(codon, codes.CODE_ORDER) + 1, F.lit(1))).otherwise("X")


def is_start(codon: Column, table: Column | int = 1) -> Column:
    return F.array_contains(_by_table(table, [codes.starts(t) for t in codes.TABLES]), to_rna(codon))


def is_stop(codon: Column, table: Column | int = 1) -> Column:
    return F.array_contains(_by_table(table, [codes.stops(t) for t in codes.TABLES]), to_rna(codon))


def initiation_type(codon: Column, table: Column | int = 1) -> Column:
    return F.when(to_rna(codon) == "AUG", "canonical").when(is_start(codon, table), "near_cognate").otherwise("invalid")


def _letters(rna: pa.Array, table: pa.Array) -> pa.Array:
    """Proteins of a batch: bases become digits, three digits and the table's number a place in the codes' letters.

    A lambda a codon is evaluated without code generation, at a few hundred ns a codon; this is one gather."""
    digit = np.full(256, 4, np.uint8)
    digit[list(codes.CODE_ORDER.encode())] = range(4)
    letters = np.frombuffer("".join(codes.amino_acids(t) for t in codes.TABLES).encode(), np.uint8)
    rna = rna.cast(pa.binary())
    known = rna.is_valid().to_numpy(zero_copy_only=False).copy()
    size = pa.compute.binary_length(rna).fill_null(0).to_numpy()
    bases = digit[np.frombuffer(b"".join(rna.drop_null().to_pylist()), np.uint8)]
    if (bases == 4).any():  # what is no base parts the codons: such rows are rare and done one by one
        strip = lambda x: b"".join(re.findall(rb"[ACGU]{3}", x))
        rna = pa.array([None if x is None else strip(x) for x in rna.to_pylist()], pa.binary())
        size = pa.compute.binary_length(rna).fill_null(0).to_numpy()
        bases = digit[np.frombuffer(b"".join(rna.drop_null().to_pylist()), np.uint8)]
    n = size // 3
    ends = np.cumsum(n)
    start = np.repeat(np.cumsum(size) - size, n) + 3 * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n))
    t = table.cast(pa.int64()).fill_null(0).to_numpy()
    known &= (t >= 1) & (t <= 33)
    code = np.repeat(np.where(known, t, 1) - 1, n)
    out = letters[code * 64 + bases[start] * 16 + bases[start + 1] * 4 + bases[start + 2]].tobytes()
    offsets = np.append(0, ends).tolist()
    return pa.array([out[a:b].decode() if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], known, strict=True)], pa.string())


def translate(rna: Column, table: Column | int = 1) -> Column:
    """Every codon's letter, stops as *; the first codon is not made M. Null for a table outside 1..33."""

    @F.arrow_udf("string")
    def protein(x: pa.Array, t: pa.Array) -> pa.Array:
        return _letters(x, t)

    return protein(rna, F.lit(table) if isinstance(table, int) else table)


def translate_cds(rna: Column, table: Column | int = 1) -> Column:
    """M for the start codon, without the last stop; null unless it starts, stops and has no stop between."""
    protein = translate(rna, table)
    body = F.concat(F.lit("M"), F.substring(protein, F.lit(2), F.length(protein) - 2))
    whole = (F.length(rna) % 3 == 0) & (F.length(rna) >= 6) & is_start(F.substring(rna, 1, 3), table) & is_stop(F.right(rna, F.lit(3)), table)
    return F.when(whole & ~body.contains("*"), body)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of equally long strings; null if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(a == b, 0).when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def stable_accession(x: Column) -> Column:
    """Trimmed, upper case, without a version."""
    return F.regexp_replace(F.upper(F.trim(x)), r"\.\d+$", "")


def entropy_bits(p: Column) -> Column:
    """A term of Shannon's entropy."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def json_rank(label: str, seed: int, *values: Column) -> Column:
    """SHA-256 over a JSON array of a label, a seed and string values (ASCII)."""
    quoted = [x for v in values for x in (F.lit(',"'), v, F.lit('"'))]
    return F.sha2(F.concat(F.lit(f'["{label}",{seed}'), *quoted, F.lit("]")), 256)


def text_rank(seed: int, *values: Column) -> Column:
    """SHA-256 over seed and values joined by colons."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *values), 256)


def log_frame_loss(p: Column, bases: Column) -> Column:
    """Bits a base of a natural log-probability."""
    return F.when(bases > 0, -p / (bases * F.log(F.lit(2.0))))
