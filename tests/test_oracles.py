"""Every registered query with SQL returns what DuckDB returns on the smallest tables."""

import pytest

from oracle_check import compare, connect
from tallyforge.plans.registry import ORACLES, QUERIES, load_all

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, verdict = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert verdict.startswith("ok") or verdict == "rows-only", verdict
