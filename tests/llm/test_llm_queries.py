"""Every query of the package that has SQL against its SQL."""

import pytest

from newsignal.llm import queries
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = queries.oracle()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_belongs_to_queries():
    assert set(queries.registered()) - set(SQL) == {
        "op4_importance_resampling",
        "op6_near_duplicates",
        "op7_pii",
        "op8_language_id",
    }


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, con, name):
    assert compare(queries.registered()[name](spark, SF), con, SQL[name]) is None
