import pytest
from oracle import compare

from verdigris.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", queries.queries()[name], queries.oracle_sql()[name])
