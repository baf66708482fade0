"""Each named query gives the rows of its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from quaestor.plans import load_all
from quaestor.plans.registry import ORACLES, QUERIES
from tests.oracle import difference, duck, duck_rows, folder, spark_rows

load_all()


@pytest.fixture(scope="module")
def con():
    return duck(folder())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, key):
    got = spark_rows(QUERIES[key](spark, folder()))
    assert got[1], "no rows"
    if key in ORACLES:
        assert difference(got, duck_rows(con, ORACLES[key])) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
