"""The entry points without the training-data part, or without a package it needs."""

import sys

import pytest

import __spark_entry__ as entry_points


@pytest.mark.parametrize("lost", ["zstandard", "tablemill.llm", "corpus_pipeline"])
def test_other_queries_stay(monkeypatch, lost):
    whole = set(entry_points.queries())
    for name in [n for n in sys.modules if n.startswith(("tablemill.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, lost, None)
    with pytest.warns(UserWarning, match="left out"):
        left = set(entry_points.queries())
    assert "accuracy" in left and "pipeline" not in left
    assert left >= {n for n in whole if not n.startswith("op") and n != "pipeline"}
    assert set(entry_points.oracle_sql()) <= whole
