"""Every registered query with SQL agrees with it on the small tables; the rest return rows."""

import os

import pytest

import __spark_entry__ as registered
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()
# long iterative queries are covered by tests/test_invariants.py on small graphs
SLOW = {"communities", "community_labels", "convolution_models", "record_vectors_from_levels"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    ok, message, _, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, message


def test_entry(spark):
    assert registered.entry(spark).count() > 0
