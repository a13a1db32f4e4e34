import pytest

from codeloom.plans import core_problems, index_queries, parse_queries, report_queries
from oracle import same

WITH_SQL = [(m, n) for m in (index_queries, core_problems, report_queries, parse_queries) for n in m.QUERIES if n in m.ORACLE]
WITHOUT = [(m, n) for m in (index_queries, core_problems, report_queries, parse_queries) for n in m.QUERIES if n not in m.ORACLE]


@pytest.mark.parametrize("module,name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_query_matches_sql(spark, data, module, name):
    same(spark, data, module.QUERIES[name], module.ORACLE[name])


@pytest.mark.parametrize("module,name", WITHOUT, ids=[n for _, n in WITHOUT])
def test_query_runs(spark, data, module, name):
    assert module.QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
