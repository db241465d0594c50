"""Registered queries against DuckDB on the smallest tables.

All queries run with TICKLOOM_ALL=1; by default every twelfth one does.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

DATA = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())
CHOSEN = NAMES if os.environ.get("TICKLOOM_ALL") else NAMES[::12]


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    problems = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], DATA)
    # some pairings need more users or suppliers than this size has
    problems = [p for p in problems if not p.startswith("EMPTY")]
    assert not problems, problems


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
