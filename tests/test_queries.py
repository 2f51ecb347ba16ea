import pytest

from tessera.plans import suite

from .conftest import DATA
from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(suite.ORACLE))
def test_equals_oracle(spark, duck, name):
    assert_same(suite.QUERIES[name](spark, DATA), duck, suite.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - set(suite.ORACLE)))
def test_runs(spark, name):
    assert suite.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(suite.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = suite.QUERIES["scan_project"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "l_comment" not in plan
