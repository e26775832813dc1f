import pytest

import __spark_entry__ as entry
from oracle import connect, same

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, small, name):
    same(QUERIES[name](spark, small), connect(small), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.count()


def test_sql_names_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
