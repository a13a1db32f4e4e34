import pytest

from codeloom.llm import queries
from oracle import same


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, data, name):
    if name in queries.ORACLE:
        same(spark, data, queries.QUERIES[name], queries.ORACLE[name])
    else:
        assert queries.QUERIES[name](spark, data).count() > 0
