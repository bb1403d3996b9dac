import pytest

from lineweave import library_queries
from lineweave import queries as own

from .conftest import SMALL
from .oracle import compare


SQL = own.SQL | library_queries.SQL
QUERIES = own.queries() | library_queries.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SMALL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
