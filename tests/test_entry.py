import importlib

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "blocks", "body_blocks", "units", "batches", "chars", "suspicious"] and df.count() == 200


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_parts(monkeypatch):
    monkeypatch.setattr(entry, "_present", lambda module: False)
    assert "document_summary" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert importlib.import_module("folioflow.plans.queries")
