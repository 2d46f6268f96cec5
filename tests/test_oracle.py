"""Every registered plan against its DuckDB twin on the smallest supplied tables."""

import os

import pytest
from oracle import connect, difference, run_duckdb, run_spark

from __spark_entry__ import entry, oracle_sql, queries
from querylore.plans.registry import all_plans

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not found")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_plans()))
def test_plan_equals_twin(spark, con, name):
    got = run_spark(queries()[name](spark, FOLDER))
    assert got[1], "no rows"
    assert difference(got, run_duckdb(con, oracle_sql()[name])) is None


def test_entry(spark):
    assert entry(spark).count() > 0
