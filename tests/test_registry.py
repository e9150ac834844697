import importlib
import sys

import pytest

import __spark_entry__ as entry
from docspark.plans import registry
from oracle import same

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    assert same(spark, registry.QUERIES[name], registry.ORACLES[name], SF) > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["book_id", "ord", "name", "content_md5"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("lacking", ["docspark.llm", "corpus_pipeline"])
def test_core_queries_come_without_the_others(monkeypatch, lacking):
    """Whatever of the training-data operators can't be imported, the queries of this registry stay."""
    monkeypatch.setitem(sys.modules, lacking, None)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(registry.QUERIES) and set(alone.oracle_sql()) == set(registry.ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
