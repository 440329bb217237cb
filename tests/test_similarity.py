"""Runs that similar sequences are sought among, in plain Python."""

import hashlib

from seqloom.operators import similarity
from seqloom.sources.views import cds


def test_clusters_cover_records_to_their_last_base(spark, sf):
    want = set()
    for r in cds(spark, sf).select("family", "taxon", "rna").collect():
        want |= {(r.family, r.taxon, hashlib.sha256(r.rna[k : k + 24].encode()).hexdigest()) for k in range(0, len(r.rna), 24)}
    got = similarity.g1(spark, sf).select("family", "taxon", "sequence_sha256").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
