"""Every registered query against its SQL."""

import pytest
from oracle import duck_rows, spark_rows

from seqloom import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    wanted, expected = duck_rows(SQL[name], sf)
    assert names == wanted
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "reason" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
