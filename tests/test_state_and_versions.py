"""Streams that keep state over batches, versions of the index, and what containment reads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_events_export import at, run_stream
from waymark.operators import index, search
from waymark.streaming import events


def test_answers_to_older_requests_are_dropped_in_later_batches(spark, tmp_path):
    schema = "user_id long, ts timestamp, kind string, request_id long, answer string"
    parts = [
        [(1, at(1), "asked", 1, None), (2, at(1), "asked", 7, None), (2, at(1), "answered", 7, "two")],
        [(1, at(2), "asked", 2, None), (1, at(3), "answered", 1, "late")],
        [(1, at(4), "answered", 2, "new"), (1, at(5), "answered", 2, "again"), (2, at(5), "answered", 6, "old"), (3, at(5), "answered", 1, "never asked")],
    ]
    got = run_stream(spark, tmp_path, [spark.createDataFrame(p, schema) for p in parts], events.latest_answers, "append")
    assert sorted((r["user_id"], r["request_id"], r["answer"]) for r in got) == [(1, 2, "new"), (2, 7, "two")]


def test_the_current_fix_is_one_row_of_state_a_user(spark, tmp_path):
    schema = "user_id long, ts timestamp, kind string, text string, lat double, lon double"
    parts = [
        [(1, at(k), "fix", None, float(k), 0.0) for k in range(1, 40)] + [(1, at(10), "query", "a", None, None), (2, at(1), "query", "none", None, None)],
        [(1, at(41), "query", "b", None, None), (1, at(20), "fix", None, -1.0, 0.0)],
        [(1, at(50), "fix", None, 50.0, 0.0), (1, at(49), "query", "c", None, None), (1, at(51), "query", "d", None, None)],
    ]
    got = run_stream(spark, tmp_path, [spark.createDataFrame(p, schema) for p in parts], events.with_current_fix, "append")
    assert {r["text"]: r["fix_lat"] for r in got} == {"a": 10.0, "none": None, "b": 39.0, "c": 39.0, "d": 50.0}
    folder = tmp_path / "state"
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    query = events.with_current_fix(stream).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) == 2  # users


def termed(spark, words):
    rows = [(k, w, w, "place=x", 0.0, 0.0) for k, w in enumerate(words)]
    return index.terms(spark.createDataFrame(rows, "place_id long, name string, context string, category string, lon double, lat double"))


def test_a_failed_build_leaves_the_old_index(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "i")
    index.write_index(termed(spark, ["garden", "winter"]), folder)
    first = index.current_version(spark, folder)
    monkeypatch.setattr(index, "prefixes", lambda vocab: vocab.select(F.raise_error(F.lit("killed")).alias("key"), F.col("word").alias("candidate")))
    with pytest.raises(Exception, match="killed"):
        index.write_index(termed(spark, ["summer"]), folder)
    monkeypatch.undo()
    assert index.current_version(spark, folder) == first
    assert {r["word"] for r in index.Index.open_stored(spark, folder).vocab.collect()} == {"garden", "winter"}
    held = index.Index.open(spark, folder)
    index.write_index(termed(spark, ["summer"]), folder)
    assert {r["word"] for r in held.vocab.collect()} == {"garden", "winter"}  # a search under way
    index.write_index(termed(spark, ["autumn"]), folder)
    assert {r["word"] for r in index.Index.open(spark, folder).vocab.collect()} == {"autumn"}
    assert len([n for n in (tmp_path / "i").iterdir() if n.name.startswith("version-")]) == 2
    with pytest.raises(FileNotFoundError):
        index.Index.open(spark, str(tmp_path / "none"))


def test_containment_reads_the_thinnest_lists(spark):
    words = sorted({f"{a}ing{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in ("zq", "xy", "")} | {"singular", "sinking"})
    built = index.Index.of(termed(spark, words))
    probes = spark.createDataFrame([("inghzqq", "inghz"), ("ingzzz", "ingzz"), ("singulat", "singul")], "word string, probe string")
    like = F.expr("candidate like concat('%', probe, '%')")
    first = probes.withColumn("gram", F.get(search.usable_grams(F.col("probe")), F.lit(0))).join(built.grams, "gram")
    thin = search.by_grams(probes, built)
    found = lambda df: {(r["word"], r["candidate"]) for r in df.where(like).collect()}
    assert found(thin) == found(first) and len(found(thin)) == 9
    assert 5 * thin.count() <= first.count()
