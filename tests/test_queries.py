"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as driver
from newsignal.plans import catalog
from newsignal.plans.oracle import oracle
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = oracle()
QUERIES = catalog.registered()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_belongs_to_queries():
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"classify_text"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() > 0 and len(out.columns) > 1


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["date", "mean_polarity"] and out.count() == 30
