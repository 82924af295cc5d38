"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as registered  # noqa: E402
from compare import compare, duck  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registered.queries(), registered.oracle_sql()


def llm(name):
    """Tested with their own operators."""
    return name in getattr(registered, "LLM_QUERIES", {})


@pytest.fixture(scope="module")
def con():
    connection = duck(SF_DIR)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert {n for n in QUERIES if not llm(n)} == {n for n in SQL if not llm(n)}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not llm(n)))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF_DIR) == ""


def test_entry(spark):
    assert registered.entry(spark).limit(1).count() == 1
