"""Every registered query that SQL can express gives the rows of its SQL."""

import pytest

from quillon.plans import registry
from tests import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.check(spark, registry.QUERIES[name], registry.ORACLES[name], f"{oracle.DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows_and_a_stable_schema(spark, name):
    sf = f"{oracle.DATA}/sf0.001"
    df = registry.QUERIES[name](spark, sf)
    assert df.count() > 0
    assert df.schema == registry.QUERIES[name](spark, sf).schema


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
