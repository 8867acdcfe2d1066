from __future__ import annotations

import pytest

from loomfold.plans import core
from tests.oracle import DATA, connect, same

QUERIES, SQL = core.queries(), core.oracle_sql()
SLOW = {"p1_found", "p4_found", "p4_hierarchy"}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_same_as_sql(spark, con, name):
    same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
