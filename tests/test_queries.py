"""Every registered query with SQL against DuckDB, on the smallest tables."""

import pytest

from quire.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
