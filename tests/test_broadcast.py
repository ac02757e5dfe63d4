"""A batch's own small tables are broadcast, so that the index's tables are not shuffled to meet them."""

from __future__ import annotations

from waymark.lineage import settle
from waymark.operators import search


def test_index_tables_are_not_shuffled(spark):
    prefixes = spark.createDataFrame([("abc", "abcd", 4, 1, 1)], "key string, candidate string, n_chars int, places long, blob_bytes long")
    asked = settle(spark.createDataFrame([("abc",)], "word string"))
    found = search.prefix_candidates(asked, settle(prefixes))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r["candidate"] for r in found.collect()] == ["abcd"]
    assert "broadcast" not in search.beside(asked, 0)._jdf.queryExecution().toString().lower()
