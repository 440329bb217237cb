"""Gap cases against the annotated domains of their family: the first domain is primary, the others show in the codons' arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import r6
from ..plans.storage import Scratch
from ..registry import query
from ..sources.views import cds
from .family_profiles import as_text
from .sampling import _ANCHOR, anchors

GAP = 4


def domain_features(cases: DataFrame, domains: DataFrame, gap: int) -> DataFrame:
    """cases (case_id, family, start, n_codons) with the place of the gap's `gap` codons among the domains (family, ordinal,
    domain_id, first, last; places from 0, last included) of their family.

    Ends are cut to the record's last codon; the domain of the smallest ordinal is primary and gives kind, distances (negative
    outside) and relative places; per_codon_domains names every domain that holds a codon, in order, joined by `+`. Families
    meet their domains as one array each, so a case is one row throughout. Defined results: without domains (or family)
    distances and relative places are null, kind is no_domain_annotation and no codon is in a domain; a record without
    codons has no relative place in itself."""
    order = F.sort_array(F.collect_list(F.struct("ordinal", "domain_id", "first", "last")))
    known = domains.where("family IS NOT NULL AND first IS NOT NULL AND last IS NOT NULL").groupBy("family").agg(order.alias("all"))
    rows = cases.join(known, "family", "left")
    cut = F.transform("all", lambda d: F.struct(d["domain_id"].alias("id"), d["first"].alias("first"), F.least(d["last"], F.col("n_codons") - 1).alias("last")))
    rows = rows.withColumn("all", F.when(F.size("all") > 0, cut)).withColumns({"d": F.try_element_at("all", F.lit(1)), "end": F.col("start") + (gap - 1)})
    first, last, start, end = F.col("d.first"), F.col("d.last"), F.col("start"), F.col("end")
    length, centre = F.greatest(F.lit(1), last - first + 1), start + (gap - 1) / 2
    before, behind = (start < first) & (first <= end), (start <= last) & (last < end)
    inside = (start >= first) & (end <= last)
    kind = (
        F.when(F.col("d").isNull(), "no_domain_annotation").when(inside, "fully_inside_domain").when(before & behind, "straddles_both_boundaries").when(before, "straddles_n_boundary")
        .when(behind, "straddles_c_boundary").when(end < first, "outside_n_terminal").otherwise("outside_c_terminal")
    )
    near = F.when(F.col("d").isNotNull(), F.least(*[F.abs(a - b) for a in (start, end) for b in (first, last)]))
    places = F.sequence(start, end)
    within = lambda p: F.coalesce((p >= first) & (p <= last), F.lit(False))
    held = lambda p: F.array_join(F.transform(F.filter(F.coalesce("all", F.array().cast("array<struct<id:string,first:int,last:int>>")), lambda d: (p >= d["first"]) & (p <= d["last"])), lambda d: d["id"]), "+")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "case_id", "family", "start", F.coalesce(F.array_join(F.transform("all", lambda d: d["id"]), ","), F.lit("")).alias("domain_ids"), kind.alias("kind"),
        yes(inside).alias("is_inside"), yes(F.when(F.col("d").isNotNull(), F.greatest(start, first) <= F.least(end, last))).alias("is_overlapping"), yes(before).alias("straddles_n"), yes(behind).alias("straddles_c"),
        (start - first).alias("distance_to_start"), (last - end).alias("distance_to_end"), near.alias("least_distance"),
        r6((centre - first) / length).alias("relative_domain_position"), r6(F.when(F.col("n_codons") > 0, centre / F.col("n_codons"))).alias("relative_position"),
        F.transform(places, within).alias("per_codon_in_domain"), F.transform(places, lambda p: F.when(within(p), r6((p - first) / length))).alias("per_codon_relative"),
        F.transform(places, held).alias("per_codon_domains"),
    )


def family_domains(records: DataFrame) -> DataFrame:
    """Domains by rule: three overlapping ones for each family of the records but one, shifted by the family's hash."""
    shift = (F.conv(F.substring(F.md5("family"), 1, 2), 16, 10).cast("int") % 40).alias("shift")
    rows = records.where("family <> 'es'").select("family").distinct().select("family", shift, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ordinal"))
    first = F.col("shift") + 60 * F.col("ordinal")
    return rows.select("family", "ordinal", F.concat(F.lit("D"), F.col("ordinal").cast("string")).alias("domain_id"), first.cast("int").alias("first"), (first + 80 + 150 * F.col("ordinal")).cast("int").alias("last"))


_FIRST, _LEN = "CAST(dom[1].f AS INTEGER)", "greatest(1, least(dom[1].l, n - 1) - dom[1].f + 1)"
_LAST = "least(dom[1].l, n - 1)"
_TEXT = "string_agg({0}, ',' ORDER BY k)"


@query(
    "F27_domain_arrays",
    f"""WITH {_ANCHOR}, fam AS (SELECT DISTINCT family, ('0x' || substr(md5(family), 1, 2))::INTEGER % 40 AS s FROM cds WHERE family <> 'es'),
    dm AS (SELECT family, [{{'f': s, 'l': s + 80}}, {{'f': s + 60, 'l': s + 290}}, {{'f': s + 120, 'l': s + 500}}] AS dom FROM fam),
    c AS (SELECT doc_id AS case_id, family, start, length(rna) // 3 AS n, start + 3 AS e, dom FROM cds JOIN anchor USING (doc_id) LEFT JOIN dm USING (family)),
    x AS (SELECT *, {_FIRST} AS f, CASE WHEN dom IS NOT NULL THEN {_LAST} END AS l, {_LEN} AS len FROM c),
    k AS (SELECT case_id, k, coalesce(start + k BETWEEN f AND l, false) AS i, CASE WHEN start + k BETWEEN f AND l THEN round((start + k - f) / len, 6) + 0.0 END AS r,
        concat_ws('+', CASE WHEN start + k BETWEEN dom[1].f AND least(dom[1].l, n - 1) THEN 'D0' END, CASE WHEN start + k BETWEEN dom[2].f AND least(dom[2].l, n - 1) THEN 'D1' END, CASE WHEN start + k BETWEEN dom[3].f AND least(dom[3].l, n - 1) THEN 'D2' END) AS d
      FROM (SELECT *, unnest(range({GAP})) AS k FROM x)),
    a AS (SELECT case_id, {_TEXT.format("i::VARCHAR")} AS per_codon_in_domain, {_TEXT.format("coalesce(CAST(CAST(r AS DECIMAL(12,6)) AS VARCHAR), '-')")} AS per_codon_relative, {_TEXT.format("d")} AS per_codon_domains FROM k GROUP BY case_id)
    SELECT case_id, family, start, CASE WHEN dom IS NULL THEN '' ELSE 'D0,D1,D2' END AS domain_ids,
      CASE WHEN dom IS NULL THEN 'no_domain_annotation' WHEN start >= f AND e <= l THEN 'fully_inside_domain' WHEN start < f AND f <= e AND start <= l AND l < e THEN 'straddles_both_boundaries' WHEN start < f AND f <= e THEN 'straddles_n_boundary'
        WHEN start <= l AND l < e THEN 'straddles_c_boundary' WHEN e < f THEN 'outside_n_terminal' ELSE 'outside_c_terminal' END AS kind,
      coalesce(start >= f AND e <= l, false) AS is_inside, dom IS NOT NULL AND greatest(start, f) <= least(e, l) AS is_overlapping, coalesce(start < f AND f <= e, false) AS straddles_n, coalesce(start <= l AND l < e, false) AS straddles_c,
      start - f AS distance_to_start, l - e AS distance_to_end, CASE WHEN dom IS NOT NULL THEN least(abs(start - f), abs(start - l), abs(e - f), abs(e - l)) END AS least_distance,
      round((start + 1.5 - f) / len, 6) + 0.0 AS relative_domain_position, round((start + 1.5) / n, 6) + 0.0 AS relative_position, per_codon_in_domain, per_codon_relative, per_codon_domains FROM x JOIN a USING (case_id)""",
)
def f27_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """The gap of four codons at each record's anchor."""
    records = cds(spark, sf)
    # only numbers are joined and written, no sequence
    lengths = records.select(F.col("doc_id").alias("case_id"), "family", F.floor(F.length("rna") / 3).cast("int").alias("n_codons"))
    starts = Scratch(spark, "starts").write(anchors(records, gap=GAP, left=4).select(F.col("doc_id").alias("case_id"), "start"), "starts")
    cases = lengths.join(starts, "case_id")
    return as_text(domain_features(cases, family_domains(records), GAP))
