"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no benchmark tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    own = set(entry.queries()) - set(entry._llm_queries())
    assert own == set(entry.oracle_sql()) & own
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_entry(spark):
    if os.path.isdir(entry.FLAGSHIP_DIR):
        assert {r.repo for r in entry.entry(spark).collect()} == {f"repo_{i}" for i in range(4)}
