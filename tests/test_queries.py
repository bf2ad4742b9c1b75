from __future__ import annotations

import pytest

import __spark_entry__ as entry
from quarrykit.plans import catalog
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, sf, name):
    assert_same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "source", "organization", "start_date"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
