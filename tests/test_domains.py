"""Domain features in literal cases."""

from seqloom.operators.domains import domain_features

CASES = "case_id int, family string, start int, n_codons int"
DOMAINS = "family string, ordinal int, domain_id string, first int, last int"


def test_kinds_distances_and_arrays(spark):
    cases = [(1, "f", 10, 100), (2, "f", 8, 100), (3, "f", 18, 100), (4, "f", 2, 100), (5, "f", 40, 100), (6, "g", 4, 9), (7, "x", 4, 9), (8, None, 4, 9), (9, "f", 8, 12), (10, "one", 3, 100), (11, "x", 0, 0)]
    domains = [("f", 1, "b", 12, 50), ("f", 0, "a", 10, 20), ("g", 0, "c", 0, 99), ("x", 0, "d", None, 5), (None, 0, "e", 0, 50), ("one", 0, "t", 4, 5)]
    got = {x.case_id: x for x in domain_features(spark.createDataFrame(cases, CASES), spark.createDataFrame(domains, DOMAINS), 4).collect()}
    kinds = ["fully_inside_domain", "straddles_n_boundary", "straddles_c_boundary", "outside_n_terminal", "outside_c_terminal", "fully_inside_domain", "no_domain_annotation", "no_domain_annotation", "straddles_n_boundary", "straddles_both_boundaries", "no_domain_annotation"]
    assert [got[k].kind for k in range(1, 12)] == kinds
    one = got[1]
    assert (one.domain_ids, one.is_inside, one.is_overlapping, one.distance_to_start, one.distance_to_end, one.least_distance) == ("a,b", True, True, 0, 7, 0)
    assert one.per_codon_domains == ["a", "a", "a+b", "a+b"] and one.per_codon_relative == [0.0, 0.090909, 0.181818, 0.272727] and one.relative_domain_position == 0.136364 and one.relative_position == 0.115
    assert got[5].per_codon_in_domain == [False] * 4 and got[5].per_codon_domains == ["b"] * 4 and got[5].distance_to_end == -23
    assert got[9].per_codon_in_domain == [False, False, True, True] and got[9].distance_to_end == 0 and got[9].straddles_n and not got[9].straddles_c  # the domain ends with the record
    for k in (7, 8):
        x = got[k]
        assert (x.domain_ids, x.is_overlapping, x.distance_to_start, x.least_distance, x.relative_domain_position) == ("", False, None, None, None)
        assert x.per_codon_in_domain == [False] * 4 and x.per_codon_relative == [None] * 4 and x.per_codon_domains == [""] * 4
    assert got[11].relative_position is None
