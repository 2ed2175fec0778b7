import pytest
from oracle import both

from mediaframe import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    ours, theirs = both(spark, queries.QUERIES, queries.ORACLES, name)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 21
    assert set(e.oracle_sql()) <= set(e.queries())
