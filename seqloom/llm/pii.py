"""Personal data: base patterns, and terms that reveal a protected entity (information-theoretic).

Entities are the values the base patterns find. Over the whole corpus three things are counted, in
documents: those that hold a term, those that hold an entity, and those that hold both. With p(e)
the chance that a document holds entity e and p(e|t) the chance that one with term t does, the
pointwise mutual information log p(e|t)/p(e) says how much of the information IC(e) = -log p(e) a
reader gains from t. Their ratio is the disclosure, 1 when t surely means e. p(e|t) is estimated
with one prior observation of chance p(e), (both + p(e)) / (n(t) + 1): entities seen once are judged
too, and little evidence gives a lower disclosure, not none. Wherever terms with a disclosure of
GENERALISE or more stand in a document that holds e, they are replaced by what kind of thing they
are, of REMOVE or more they go. Documents without an entity are left alone.

No term in more than (n(e) + p(e)) p(e)^(GENERALISE - 1) - 1 documents can tell of e, so a document's
terms are cut to those that can tell of one of its entities before pairs are made; nothing is lost.
Entities that stand in the very same documents have the same counts with every term, so they are one
class (known by its size and 128 bits of its documents' hashes), and a list of addresses in one
document, or in its copies, makes one pair a term. A term or an entity of one document meets the other once at most,
so the best disclosure of such a pair is that of the document's rarest entity: only terms and classes of two documents or
more are paired and counted. A term counts where it touches no base span.

All of it is DataFrame functions. Offsets count code points, ends are exclusive. Patterns are
written so that no text makes them backtrack: a run of characters is tried from its start only,
or from the end of the match before (\\G), and repeats are possessive where nothing after them
could use what they took. Offsets are running sums in runs of CHUNK items, and texts are cut once, from
an array of their characters: the work grows with a text's length and number of spans, not with their product.

Defined results: null or empty text has no span; very long texts are searched whole; rows with equal
id and text have equal results (their words and entities count as often as they stand there), and null
ids are kept; of overlapping spans, the one that starts first (of equals, the first kind) is replaced
whole and the rest of the others is removed with it; the letter U+2E2F is in no term; an empty
table gives an empty table; other columns are not read by spans() and are kept by sanitise().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch, unused

#: Fixed patterns and their order.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
#: Stands in place of base spans when terms are looked for: a letter, so that what touches it is no whole run.
FILLER = "\u2e2f"
TERM = rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}&&[^{FILLER}]]{{3,}}+(?!{FILLER})"
#: The same in a text without FILLER, where a run can only begin at its start.
RAW_TERM = r"[\p{L}\p{N}]{3,}+"
CHUNK = 256
GENERALISE, REMOVE = 0.8, 0.95


def _digits(x: F.Column) -> F.Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: F.Column) -> F.Column:
    """Whether 12 to 19 digits pass; false for any other number of them."""
    n = F.length(digits)

    def step(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, value: F.Column) -> F.Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _let(value: F.Column, body) -> F.Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(sizes: F.Column, zero: int, add) -> F.Column:
    """What add() makes of zero and the items before each item of an array<int> (a column or lambda variable)."""

    def fold(items, start):
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, state, step, lambda acc: acc["out"])

    def joined(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), add))
        return F.flatten(F.zip_with(chunks, fold(totals, F.lit(zero)), fold))

    last = F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK)).cast("int")
    return _let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(sizes, k * CHUNK + 1, CHUNK)), joined)


def _matches(text: F.Column, pattern: str) -> F.Column:
    """array<struct<start,value>> of a pattern's matches: what stands between them gives the offsets."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(pairs):
        sizes = F.transform(pairs, lambda p: p["gap"] + F.length(p["value"]))
        starts = _let(sizes, lambda x: _running(x, 0, lambda a, b: a + b))
        return F.zip_with(pairs, starts, lambda p, at: F.struct((at + p["gap"]).alias("start"), p["value"].alias("value")))

    # the last piece stands after the last match
    pairs = F.zip_with(found, between, lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap")))
    return _let(F.filter(pairs, lambda p: p["value"].isNotNull()), placed)


def _replaced(text: F.Column, marks: F.Column) -> F.Column:
    """text with what marks (array<struct<start,end,put>>, by start) say: a mark that starts within what came before
    removes only what it has more. Null for null marks."""
    cut = lambda chars, a, b: F.array_join(F.slice(chars, a + 1, F.greatest(F.lit(0), b - a)), "")

    def put(both):
        chars, ends = both["chars"], F.transform(both["marks"], lambda m: m["end"])
        done = _let(ends, lambda e: _running(e, 0, lambda a, x: F.greatest(a, x)))
        piece = lambda m, at: F.concat(cut(chars, at, m["start"]), F.when(m["start"] >= at, m["put"]).otherwise(""))
        tail = cut(chars, F.coalesce(F.array_max(ends), F.lit(0)), F.size(chars))
        return F.concat(F.array_join(F.zip_with(both["marks"], done, piece), ""), tail)

    return F.when(marks.isNotNull(), _let(F.struct(F.split(text, "").alias("chars"), marks.alias("marks")), put))


NONE = "array<struct<start:int,rank:int,end:int,value:string>>"
PLACES = "array<struct<start:int,end:int,value:string,share:double>>"


def _of_kind(text: F.Column, kind: str) -> F.Column:
    full = F.transform(
        _matches(text, PATTERNS[kind]),
        lambda m: F.struct(
            m["start"], F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")
        ),
    )
    return F.when(text.rlike(HINTS[kind]), F.filter(full, lambda m: _valid(kind, m["value"]))).otherwise(F.array().cast(NONE))


def base_spans(text: F.Column) -> F.Column:
    """array<struct<start,rank,end,value>> of the base patterns, by start, then kind."""
    return F.array_sort(F.concat(*[_of_kind(text, k) for k in KINDS]))


def _terms(text: F.Column, pattern: str = TERM) -> F.Column:
    """Distinct lower-cased terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _masked(text: F.Column, base: F.Column) -> F.Column:
    """text with FILLER in place of base spans, as long as it was. base: a column."""

    def marks(done):
        own = F.zip_with(base, done, lambda s, at: F.struct(F.greatest(s["start"], at).alias("start"), s["end"].alias("end")))
        own = F.filter(own, lambda m: m["end"] > m["start"])
        return F.transform(own, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.repeat(F.lit(FILLER), m["end"] - m["start"]).alias("put")))

    done = _let(F.transform(base, lambda s: s["end"]), lambda e: _running(e, 0, lambda a, x: F.greatest(a, x)))
    return _replaced(text, _let(done, marks))


def _places(text: F.Column, shares: F.Column) -> F.Column:
    """array<struct<start,end,value,share>> of the terms of a text that shares (a map) has."""
    every = F.transform(
        _matches(text, TERM),
        lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), F.try_element_at(shares, F.lower(m["value"])).alias("share")),
    )
    return F.filter(every, lambda m: m["share"].isNotNull())


def row_key(id_col: str, text_col: str) -> F.Column:
    """SHA-256 of id and text, which tells rows apart when ids repeat: rows with equal id and text have equal results."""
    return F.unhex(F.sha2(F.to_json(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), 256))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, row_key, base, added) of every row; row_key is null where there is no base span.

    base: array<struct<start,rank,end,value>>; added: array<struct<start,end,value,share>> of terms
    with their disclosure, none of which overlaps a base span."""
    scratch = Scratch(df.sparkSession, "pii")
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.withColumns({"base": base_spans(F.col("text")), "row": F.monotonically_increasing_id()})
    entity = F.transform("base", lambda s: F.concat_ws(":", s["rank"], F.lower(s["value"])))
    some = F.size("base") > 0
    hinted = F.col("text").rlike("|".join(HINTS.values()))
    found = found.select("row", id_col, "base", F.array_distinct(entity).alias("entities"), F.when(hinted, F.col("text")).alias("text"))
    found = scratch.write(found.withColumns({"row_key": F.when(some, row_key(id_col, "text")), "masked": F.when(some, _masked(F.col("text"), F.col("base")))}), "base")
    held, total = found.where(some), F.lit(float(max(found.count(), 2)))

    # texts without a hint are read as they are, the others from the table, where spans are masked
    raw = F.when(F.col("text").contains(FILLER), _terms(F.col("text"))).otherwise(_terms(F.col("text"), RAW_TERM))
    rest = found.where("text IS NOT NULL").select(F.explode(_terms(F.coalesce("masked", "text"))).alias("term"))
    forms = rows.where(~hinted).select(F.explode(raw).alias("term")).unionByName(rest).groupBy("term").agg(F.count("*").alias("n_term"))
    forms = scratch.write(forms, "forms")
    mine = held.select("row", F.explode("entities").alias("entity"))
    chance = F.least(F.lit(1.0), F.col("n_entity") / total)
    # a class: entities of the same documents
    where = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    entities = scratch.write(mine.groupBy("entity").agg(F.count("*").alias("n_entity"), *where), "entities")
    classes = mine.join(entities, "entity").select("row", "n_entity", "h1", "h2").distinct().withColumn("chance", chance)
    most = (F.col("n_entity") + F.col("chance")) * F.pow("chance", F.lit(GENERALISE - 1)) - 1 + 1e-6
    classes = scratch.write(classes.withColumn("most", most), "classes")
    highest = classes.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
    each = F.collect_list(F.when(F.col("n_entity") > 1, F.struct("n_entity", "h1", "h2", "chance", "most")))
    per_row = classes.groupBy("row").agg(each.alias("each"), F.max("most").alias("most"), F.min("chance").alias("rarest"))

    def disclosure(n_both: F.Column, chance: F.Column) -> F.Column:
        ic = -F.log2(chance)
        return F.when(ic > 0, 1 + F.log2((n_both + chance) / (F.col("n_term") + 1)) / ic).otherwise(0.0)

    terms = held.select("row", F.explode(_terms(F.col("masked"))).alias("term")).join(forms.where(F.col("n_term") <= highest), "term")
    terms = scratch.write(terms, "terms").join(per_row, "row").where("n_term <= most")
    single = terms.select("row", "term", disclosure(F.lit(1), F.col("rarest")).alias("share")).where(F.col("share") >= GENERALISE)
    both = terms.where("n_term > 1").select("row", "term", "n_term", F.inline(F.filter("each", lambda e: e["most"] >= F.col("n_term")))).drop("most")
    both = scratch.write(both, "both")
    of = ["n_entity", "h1", "h2", "term"]
    telling = (
        both.groupBy(*of, "n_term", "chance")
        .agg(F.count("*").alias("n_both"))
        .withColumn("share", disclosure(F.col("n_both"), F.col("chance")))
        .where(F.col("share") >= GENERALISE)
        .select(*of, "share")
    )
    telling = scratch.write(telling, "telling")
    shares = (
        both.join(telling, of)
        .select("row", "term", "share")
        .unionByName(single)
        .groupBy("row", "term")
        .agg(F.max("share").alias("share"))
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    )
    added = F.when(F.col("shares").isNotNull(), _places(F.col("masked"), F.col("shares")))
    found = found.join(shares, "row", "left").withColumn("added", added)
    return found.select(id_col, "row_key", "base", F.coalesce("added", F.array().cast(PLACES)).alias("added"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_email, n_ip, n_card, n_phone, base_sha256 and spans, from the rows of spans()."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])

    def spelled(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")

    def plain(s):
        return F.struct(s["start"], s["rank"], s["end"])

    term = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end")))
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.array_sort(F.concat(F.transform("base", plain), term))
    return found.select(id_col, *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled(every).alias("spans"))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All columns of df, with entities replaced by their kind and telling terms generalised or removed.

    length_col: a column that holds the number of characters, set anew where the text changes."""
    marks = spans(df, id_col, text_col).where(F.size("base") > 0)
    base = F.transform("base", lambda s: F.struct(s["start"], s["end"], F.get(F.array(*[F.lit(LABELS[k]) for k in KINDS]), s["rank"]).alias("put")))
    general = lambda t: F.when(t["value"].rlike(r"^\p{N}+$"), "<NUMBER>").otherwise("<WORD>")
    terms = F.transform(
        "added", lambda t: F.struct(t["start"], t["end"], F.when(t["share"] >= REMOVE, "").otherwise(general(t)).alias("put"))
    )
    key, marked, new = (unused(df, c) for c in ("__key", "__marks", "__new"))
    marks = marks.groupBy(F.col("row_key").alias(key)).agg(F.any_value(F.array_sort(F.concat(base, terms))).alias(marked))
    text = F.col(text_col)
    # texts without a hint of a base span have no mark, and do not move
    hinted = F.coalesce(text.rlike("|".join(HINTS.values())), F.lit(False))
    keyed = df.where(hinted).withColumn(key, row_key(id_col, text_col)).join(marks, key, "left")
    clean = _replaced(text, F.col(marked))
    # a column of its own: in one select, the length would see the new text's alias and clean it once more
    keyed = keyed.withColumn(new, F.when(F.col(marked).isNotNull(), clean))
    put = {text_col: F.coalesce(new, text_col).alias(text_col)}
    if length_col in df.columns:
        length = F.length(new).cast(dict(df.dtypes)[length_col])
        put[length_col] = F.when(F.col(marked).isNull(), F.col(length_col)).otherwise(length).alias(length_col)
    return keyed.select(*[put.get(c, F.col(c)) for c in df.columns]).union(df.where(~hinted))
