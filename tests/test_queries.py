import pytest

import __spark_entry__ as entry
from baglight.plans import registry
from tests.compare import from_spark, from_sql


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    assert from_spark(registry.QUERIES[name](spark, small)) == from_sql(registry.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, small, name):
    assert registry.QUERIES[name](spark, small).columns


def test_entry(spark, monkeypatch):
    assert entry.entry(spark).columns == ["cls", "ap", "positives"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
