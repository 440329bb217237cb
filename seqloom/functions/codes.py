"""Genetic codes, codon usage, tRNA copies, initiation priors, evidence weights.

All are small constants of a fixed size, so they may become literals or broadcast tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import DataFrame, SparkSession

BASES = "AUCG"
#: Order of the published genetic code strings.
CODE_ORDER = "UCAG"
CODONS = ["".join(c) for c in product(BASES, repeat=3)]

# The standard genetic code in CODE_ORDER as NCBI's table 1 gives it, and what other tables change (DNA letters as published).
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHANGES = {
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    10: {"TGA": "C"},
    12: {"CTG": "S"},
    13: {"AGA": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "ATA": "M", "TAA": "Y", "TGA": "W"},
    15: {"TAG": "Q"},
    16: {"TAG": "L"},
    21: {"AAA": "N", "AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
    27: {"TAA": "Q", "TAG": "Q"},
    28: {"TAA": "Q", "TAG": "Q"},
    29: {"TAA": "Y", "TAG": "Y"},
    30: {"TAA": "Q", "TAG": "Q"},
    31: {"TAA": "E", "TAG": "E"},
    33: {"AGA": "S", "AGG": "K", "TGA": "W"},
}
# Start and stop codons of each table; others have those of table 1.
STARTS = {
    1: "ATG GTG TTG",
    2: "ATT ATC ATA ATG GTG TTG",
    3: "ATA ATG",
    4: "TTA TTG CTG ATT ATC ATA ATG GTG",
    5: "TTG ATT ATC ATA ATG GTG",
    6: "ATG",
    9: "ATG GTG",
    10: "ATG",
    11: "TTG CTG ATT ATC ATA ATG GTG",
    12: "CAG ATG",
    13: "ATG GTG",
    14: "ATG",
    15: "ATG",
    16: "ATG",
    21: "ATG GTG",
    22: "ATG",
    23: "ATT ATG GTG",
    24: "ATG AGG",
    25: "TTG ATG GTG",
    26: "CTG ATG",
    27: "ATG",
    28: "ATG",
    29: "ATG",
    30: "ATG",
    31: "ATG",
    33: "ATA ATG AGG",
}
STOPS = {
    1: "TAA TAG TGA",
    2: "TAA TAG AGA AGG",
    3: "TAA TAG",
    4: "TAA TAG",
    5: "TAA TAG",
    6: "TGA",
    9: "TAA TAG",
    10: "TAA TAG",
    11: "TAA TAG TGA",
    12: "TAA TAG TGA",
    13: "TAA TAG",
    14: "TAG",
    15: "TAA TGA",
    16: "TAA TGA",
    21: "TAA TAG",
    22: "TAA TCA TGA",
    23: "TAA TAG TGA TTA",
    24: "TAA TAG",
    25: "TAA TAG",
    26: "TAA TAG TGA",
    27: "TGA",
    28: "TAA TAG TGA",
    29: "TGA",
    30: "TGA",
    31: "TGA",
    33: "TAA TAG",
}
TABLES = range(1, 34)

# Reference relative synonymous codon usage.
RSCU = {
    "AAA": 0.86, "AAC": 1.07, "AAG": 1.14, "AAU": 0.93, "ACA": 0.80, "ACC": 1.43, "ACG": 0.44, "ACU": 0.98,
    "AGA": 1.25, "AGC": 1.22, "AGG": 1.21, "AGU": 0.90, "AUA": 0.51, "AUC": 1.41, "AUG": 1.00, "AUU": 1.08,
    "CAA": 0.54, "CAC": 1.17, "CAG": 1.46, "CAU": 0.83, "CCA": 0.80, "CCC": 1.28, "CCG": 0.44, "CCU": 1.14,
    "CGA": 0.65, "CGC": 1.13, "CGG": 1.20, "CGU": 0.54, "CUA": 0.43, "CUC": 1.18, "CUG": 2.37, "CUU": 0.77,
    "GAA": 0.84, "GAC": 1.08, "GAG": 1.16, "GAU": 0.92, "GCA": 0.86, "GCC": 1.60, "GCG": 0.44, "GCU": 1.05,
    "GGA": 0.98, "GGC": 1.34, "GGG": 0.97, "GGU": 0.65, "GUA": 0.47, "GUC": 1.43, "GUG": 2.81, "GUU": 0.72,
    "UAC": 1.14, "UAU": 0.86, "UCA": 0.90, "UCC": 1.33, "UCG": 0.33, "UCU": 1.14, "UGC": 1.09, "UGG": 1.00,
    "UGU": 0.91, "UUA": 0.46, "UUC": 1.09, "UUG": 0.76, "UUU": 0.91,
}
# tRNA gene copies by codon.
TRNA = {
    "AAA": 19, "AAC": 14, "AAG": 22, "AAU": 14, "ACA": 10, "ACC": 16, "ACG": 6, "ACU": 12,
    "AGA": 8, "AGC": 11, "AGG": 5, "AGU": 11, "AUA": 5, "AUC": 16, "AUG": 20, "AUU": 16,
    "CAA": 10, "CAC": 17, "CAG": 23, "CAU": 17, "CCA": 8, "CCC": 12, "CCG": 4, "CCU": 10,
    "CGA": 6, "CGC": 10, "CGG": 6, "CGU": 8, "CUA": 6, "CUC": 14, "CUG": 21, "CUU": 10,
    "GAA": 15, "GAC": 17, "GAG": 10, "GAU": 17, "GCA": 11, "GCC": 26, "GCG": 5, "GCU": 26,
    "GGA": 11, "GGC": 16, "GGG": 7, "GGU": 16, "GUA": 5, "GUC": 12, "GUG": 18, "GUU": 10,
    "UAC": 14, "UAU": 14, "UCA": 10, "UCC": 16, "UCG": 5, "UCU": 12, "UGC": 10, "UGG": 10,
    "UGU": 10, "UUA": 6, "UUC": 16, "UUG": 12, "UUU": 16,
}
# Initiation weights, evidence tier weights.
INITIATION = {"AUG": 1.0, "CUG": 0.6, "GUG": 0.5, "UUG": 0.4, "ACG": 0.3, "AUU": 0.2}
TIER_WEIGHTS = {1: 1.0, 2: 0.75, 3: 0.5, 4: 0.1}


def amino_acids(table: int = 1) -> str:
    """64 letters in CODE_ORDER."""
    out = list(STANDARD)
    for codon, aa in CHANGES.get(table, {}).items():
        a, b, c = (CODE_ORDER.index(x) for x in codon.replace("T", "U"))
        out[16 * a + 4 * b + c] = aa
    return "".join(out)


def code_map(table: int = 1) -> dict[str, str]:
    return dict(zip(("".join(c) for c in product(CODE_ORDER, repeat=3)), amino_acids(table), strict=True))


def starts(table: int = 1) -> list[str]:
    return STARTS.get(table, STARTS[1]).replace("T", "U").split()


def stops(table: int = 1) -> list[str]:
    return STOPS.get(table, STOPS[1]).replace("T", "U").split()


def genetic_codes(spark: SparkSession) -> DataFrame:
    """(translation_table, codon, aa, is_start, is_stop): 33 x 64 rows."""
    rows = [(t, c, a, c in starts(t), c in stops(t)) for t in TABLES for c, a in code_map(t).items()]
    return spark.createDataFrame(rows, "translation_table int, codon string, aa string, is_start boolean, is_stop boolean")


def codon_usage(spark: SparkSession) -> DataFrame:
    """(codon, aa, rscu, w_cai, w_tai) of the 61 sense codons of table 1; weights are at least 0.01."""
    code = code_map(1)
    sense = [c for c in sorted(code) if code[c] != "*"]
    best = {a: max(RSCU[c] for c in sense if code[c] == a) for a in set(code.values()) - {"*"}}
    most = float(max(TRNA.values()))
    rows = [(c, code[c], RSCU[c], max(RSCU[c] / best[code[c]], 0.01), max(TRNA[c] / most, 0.01)) for c in sense]
    return spark.createDataFrame(rows, "codon string, aa string, rscu double, w_cai double, w_tai double")


def vocabulary(spark: SparkSession) -> DataFrame:
    """(id, codon): the 64 codons in vocabulary order."""
    return spark.createDataFrame(list(enumerate(CODONS)), "id int, codon string")


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows, for the SQL beside a query."""

    def literal(x: object) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def gc_sql(tables: Iterable[int]) -> str:
    return values_sql("gc", "translation_table, codon, aa, is_start, is_stop", [(t, c, a, c in starts(t), c in stops(t)) for t in tables for c, a in code_map(t).items()])


#: Codes 1 and 2, usage weights, and the vocabulary as CTEs.
GC_SQL = gc_sql((1, 2))
USAGE_SQL = values_sql("usage", "codon, rscu, copies", [(c, RSCU[c], TRNA[c]) for c in sorted(RSCU)])
VOCABULARY_SQL = values_sql("vocab", "id, codon", list(enumerate(CODONS)))
