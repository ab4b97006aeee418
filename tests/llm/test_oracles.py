import pytest

from quillon.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.check(spark, queries.QUERIES[name], queries.ORACLES[name], f"{oracle.DATA}/sf0.001")
