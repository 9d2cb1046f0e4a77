"""The driver's contract, with and without the optional subpackage."""

import importlib
import sys


def test_entry_gives_ranked_items(spark):
    import __spark_entry__ as e

    assert {r.item for r in e.entry(spark).collect()} == {"click", "error", "purchase", "signup", "view"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_part(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    without = importlib.reload(e)
    assert "btl" in without.queries() and not any(k.startswith("op") and k[2].isdigit() for k in without.queries())
    monkeypatch.undo()
    importlib.reload(e)
