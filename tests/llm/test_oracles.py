import pytest
from chronomesh.llm.registry import oracle_sql, queries

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries()[name], oracle_sql()[name], "/root/testdata/sf0.001")
