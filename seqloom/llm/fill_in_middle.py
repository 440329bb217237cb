"""Fill-in-the-middle transformation: texts cut at two seeded ranks of their units and put together in a new order.

A unit is a run of ASCII letters or one other character, matched left to right over code points. A text is read by
a matcher in two passes of constant memory: the first counts its units, which fixes the ranks; the second advances a
lazy iterator of matches to the smaller and then to the larger rank, and keeps the two offsets. No array of units,
offsets or pieces exists at any time, so memory is that of the text and its output, however long it is. Rows are
independent: one map over the table, without a shuffle or any state.

Four unsigned integers, the 8-digit groups of the hex SHA-256 of `1:` and the decimal id, decide a row: the first two
(modulo units + 1) the ranks, the third (modulo 100) whether it is transformed at all, the fourth which form it takes.
Sentinels `<P>`, `<S>` and `<M>` mark prefix, suffix and middle; they do not overlap themselves or each other, and a
text that holds one stays as it is, so an output and its form give the text back exactly.

Defined results: a null text is empty; an empty one is plain; a null id is written as nothing (`1:`); rows with one
id are cut alike as far as their units allow; offsets are code points; an empty table gives an empty one; columns
that are not named here pass through, unless they have the name of a result, which replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import unused

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20
MADE = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"
_MADE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def offsets_at(text: str, low: int, high: int) -> tuple[int, int]:
    """The offsets after the first `low` and the first `high` units: an iterator advanced to one rank, then to the other."""
    matches = UNIT.finditer(text)

    def advanced(steps: int, at: int) -> int:
        last = next(islice(matches, steps - 1, steps), None) if steps else None
        return last.end() if last else at

    first = advanced(low, 0)
    return first, advanced(high - low, first)


def transformed(text: str, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of one text under its four integers."""
    n = sum(1 for _ in UNIT.finditer(text))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= FIM_PERCENT:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = offsets_at(text, low, high)
    if h[3] % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def restored(output: str, form: str) -> str:
    """The text that gave an output of a form."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, b = output.index(second), output.index(MIDDLE)
    parts = {first: output[len(first) : a], second: output[a + len(second) : b]}
    return parts[PREFIX] + output[b + len(MIDDLE) :] + parts[SUFFIX]


def _made(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """One text at a time: from (text, the id's digest)."""
    for texts, digests in columns:
        rows = (transformed(t.as_py(), [int(d.as_py()[k : k + 8], 16) for k in (0, 8, 16, 24)]) for t, d in zip(texts, digests, strict=True))
        fields = _MADE.names
        yield pa.array([dict(zip(fields, r, strict=True)) for r in rows], _MADE)


def _restored(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for outputs, forms in columns:
        yield pa.array([restored(o.as_py(), f.as_py()) for o, f in zip(outputs, forms, strict=True)], pa.string())


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without its text, with n, form, prefix_chars, middle_chars and output."""
    made = unused(df, "made")
    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    results = ["n", "form", "prefix_chars", "middle_chars", "output"]
    keep = [c for c in df.columns if c.lower() not in results and c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.arrow_udf(_made, MADE)(text, seed).alias(made))
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{made}`.{c}") for c in results])


def restore(df: DataFrame, name: str = "text", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """df with the texts, under `name`, that gave its outputs."""
    return df.withColumn(name, F.arrow_udf(_restored, "string")(F.col(f"`{output_col}`"), F.col(f"`{form_col}`")))


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Transformed rows with digests of the output and of the text restored from it."""
    rows = restore(df.select(id_col, "n", "form", "prefix_chars", "middle_chars", "output"), "restored")
    return rows.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_H = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {0}, 8) AS BIGINT)"

SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM documents
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
      WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
