"""Scratch folders belong to the thread that made them."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from oracle import duck_rows, spark_rows

from seqloom import catalog
from seqloom.plans.storage import Scratch, recording


def test_owners_in_threads(spark):
    """Two owners whose lives overlap and that are equal as lists: each keeps and deletes its own."""
    meet = Barrier(2)

    def run(k: int) -> tuple[int, list[int]]:
        with recording() as made:
            meet.wait()
            mine = Scratch(spark, f"t{k}")
            table = mine.write(spark.range(5), "rows")
            meet.wait()
            if k:
                meet.wait()
            found = table.count()
            assert made == [mine]
        if not k:
            meet.wait()
        return k, found

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(run, range(2))) == [(0, 5), (1, 5)]


def test_queries_in_threads(spark, sf):
    names = ["J6_holdout_split", "J7_leakage_verify", "S11_ledger_scan"]
    queries, sql = catalog.queries(), catalog.oracle_sql()
    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(lambda n: spark_rows(queries[n](spark, sf)), names))
    assert found == [duck_rows(sql[n], sf) for n in names]
