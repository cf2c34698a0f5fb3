import pytest

from lumasieve.llm.queries import ORACLE, QUERIES

from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, data, name):
    compare(QUERIES[name](spark, data), ORACLE[name], connect(data))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
