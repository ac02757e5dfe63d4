"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry_module


def test_entry_gives_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns[:3] == ["query_id", "pos", "place_id"] and df.count() > 0


def test_every_engine_query_has_an_oracle():
    from waymark.plans.registry import ORACLE_SQL, QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
