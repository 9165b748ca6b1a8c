"""Every registered query against its SQL on the same tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from tierscore.plans.catalog import REGISTRY

CHECKED = [n for n, q in REGISTRY.items() if q.sql is not None]
UNCHECKED = [n for n, q in REGISTRY.items() if q.sql is None]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, sf_dir, name):
    got = entry_points.queries()[name](spark, sf_dir)
    assert difference(got, con, entry_points.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(spark, sf_dir, name):
    assert entry_points.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert sum(r["rows"] for r in rows) == 1500
    assert all(r["allow"] + r["deny"] + r["review"] == r["rows"] for r in rows)
