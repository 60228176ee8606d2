"""Every query with SQL gives DuckDB's result; the entry runs."""

import pytest

from tidelog import queries as logs


@pytest.mark.parametrize("name", sorted(logs.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, same, name):
    same(logs.queries()[name](spark, sf), duck.sql(logs.oracle_sql()[name]))


def test_all_queries_have_sql():
    assert set(logs.queries()) == set(logs.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(logs.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
