"""Every query with a SQL counterpart gives the same rows; the others run and are not empty."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# their results are checked in the tests of their modules
SLOW = {"c1_kmeans_sweep_profiles", "c7_k_medoids_exact_step", "c11_mini_batch_kmeans"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20
    assert [r["count"] for r in rows] == sorted((r["count"] for r in rows), reverse=True)
