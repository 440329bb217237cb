"""Feature locations as columns: nested join, complement and partial ends become ordered parts. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import reverse_complement

PART = "struct<first:long,last:long,strand:int,exact:boolean,remote:boolean>"
_STACK = f"array<array<{PART}>>"
_TOKEN = r"([a-z\-]+\(|\)|[^(),\s]+)"
_WHOLE = r"^(?:[A-Za-z0-9_.]+:)?<?[0-9]+(?:(?:\.\.|[.^])>?[0-9]+)?>?$"


def _part(token: Column) -> Column:
    """One span: first and last base (from 1), whether both ends are exact, whether it is of another record."""
    span = F.substring_index(token, ":", -1)
    numbers = F.regexp_extract_all(span, F.lit(r"([0-9]+)"), F.lit(1))
    first, last = F.try_element_at(numbers, F.lit(1)).try_cast("long"), F.try_element_at(numbers, F.lit(-1)).try_cast("long")
    exact = ~span.rlike(r"[<>^]") & ~span.rlike(r"[0-9]\.[0-9]")
    return F.struct(first.alias("first"), last.alias("last"), F.lit(1).alias("strand"), exact.alias("exact"), token.contains(":").alias("remote"))


def operators(location: Column) -> Column:
    """The names of the operators in a location, in order, with repeats."""
    return F.regexp_extract_all(location, F.lit(r"([a-z\-]+)\("), F.lit(1))


def parts(location: Column) -> Column:
    """Ordered parts, as they follow one another in the feature: a complement turns the parts inside it round and flips their
    strands, at any depth. Null for null and for what is no location (brackets that do not match, no number).

    The tokens are folded with a stack of part lists: an opening bracket pushes one, a closing one pops it into the next."""
    tokens = F.regexp_extract_all(location, F.lit(_TOKEN), F.lit(1))
    empty = F.array().cast(f"array<{PART}>")
    start = F.struct(F.array(F.lit("")).alias("ops"), F.array(empty).cast(_STACK).alias("stack"), F.lit(True).alias("good"))

    def step(s: Column, token: Column) -> Column:
        ops, stack, n = s["ops"], s["stack"], F.size(s["ops"])
        opens, closes = token.endswith("("), token == ")"
        top, below = F.element_at(stack, -1), F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0)))
        turned = F.transform(F.reverse(top), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), (-p["strand"]).alias("strand"), p["exact"].alias("exact"), p["remote"].alias("remote")))
        done = F.when(F.element_at(ops, -1) == "complement(", turned).otherwise(top)
        closed = F.concat(below, F.array(F.concat(F.try_element_at(stack, -F.least(n, F.lit(2))), done)))
        added = F.concat(F.slice(stack, F.lit(1), n - 1), F.array(F.concat(top, F.array(_part(token)))))
        new_ops = F.when(opens, F.concat(ops, F.array(token))).when(closes & (n > 1), F.slice(ops, F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(ops)
        new_stack = F.when(opens, F.concat(stack, F.array(empty))).when(closes & (n > 1), closed).when(closes, stack).otherwise(added)
        good = s["good"] & ~(closes & (n < 2)) & (opens | closes | token.rlike(_WHOLE))
        return F.struct(new_ops.alias("ops"), new_stack.cast(_STACK).alias("stack"), good.alias("good"))

    end = F.aggregate(tokens, start, step)
    found = F.when(end["good"] & (F.size(end["ops"]) == 1), F.element_at(end["stack"], 1))
    return F.when(F.size(found) > 0, found)


def extract(dna: Column, located: Column) -> Column:
    """The bases of ordered parts, those on the other strand as their reverse complement."""
    piece = lambda p: F.substring(dna, p["first"].cast("int"), (p["last"] - p["first"] + 1).cast("int"))
    return F.array_join(F.transform(located, lambda p: F.when(p["strand"] < 0, reverse_complement(piece(p))).otherwise(piece(p))), "")
