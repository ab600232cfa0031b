import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_size", "entity_count"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("hidden", ["corpus_pipeline", "tallymart.llm", "tallymart.llm.queries"])
def test_entry_without_the_corpus_operators(monkeypatch, hidden):
    """The rest works where the corpus operators, their pipeline or what they need are not there."""
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("tallymart.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)
    try:
        alone = importlib.reload(entry)
        assert "size_breakdown" in alone.queries() and not any(n.startswith("op") and n[2].isdigit() for n in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
