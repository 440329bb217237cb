"""More hot payloads than are broadcast."""

from __future__ import annotations

from collections import Counter

from seqloom.llm import warc
from seqloom.plans.storage import Scratch


def test_more_hot_payloads_than_the_limit(spark):
    rows = [(k, "http://x.org/", "payload " * 200 + str(k % 7)) for k in range(210)] + [(1000 + k, "u", "rare " * 300 + str(k // 2)) for k in range(8)]
    rows += [(None, "u", "payload " * 200 + "1"), (2000, "u", "alone " * 300), (2001, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")

    def types(**limits):
        found = warc.with_record_types(df, Scratch(spark, "hot"), **limits)
        return Counter((r.page_id, r.refers_to) for r in found.select("page_id", "refers_to").collect())

    want = types()
    assert types(hot=4, limit=2) == want and types(hot=1, limit=3) == want and types(hot=10, limit=100) == want
    assert sum(n for (_, to), n in want.items() if to is not None) == 211 + 8 - 7 - 4
