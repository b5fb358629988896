"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from rillspark.plans import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_every_query_without_sql_gives_rows(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
