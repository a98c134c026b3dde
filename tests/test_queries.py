"""Every registered query with SQL against DuckDB on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got = compare.spark_rows(entry.queries()[name](spark, sf))
    assert got == compare.duck_rows(compare.connection(sf), entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
