"""Exports, audits, as-of origins, and the streaming forms."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.functions import present
from waymark.operators import export, origin
from waymark.streaming import events

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


def test_export_numbers_nodes_and_matches_script(spark):
    places = spark.createDataFrame([(7000, 1.0, 2.0, "shop=a=b", "Київ"), (3, 1.0, 2.0, "place=x", "")], "place_id long, lon double, lat double, category string, context string")
    names = spark.createDataFrame([(7000, 1, "Kava"), (7000, 0, "Кава"), (3, 0, "X")], "place_id long, ord int, name string")
    rows = [(r["node_id"], r["name"], r["key"], r["value"]) for r in export.export_nodes(places, names).orderBy("node_id").collect()]
    assert rows == [(1, "X", "place", "x"), (2, "Кава (Київ)", "shop", "a=b"), (3, "Kava (kyiv)", "shop", "a=b")]


def test_rescue_and_audit(spark):
    nodes = spark.createDataFrame([(1, "shop", "a"), (2, "shop", "b"), (3, "place", "c")], "node_id long, key string, value string")
    ok = spark.createDataFrame([("shop=a",)], "category string")
    saved = {r["node_id"]: [tuple(t) for t in r["tags"]] for r in export.rescue(nodes, ok).collect()}
    assert saved == {1: [("shop", "a")], 2: [("shop", "b"), ("place", "locality")], 3: [("place", "locality")]}
    lines = spark.createDataFrame([("x osmid=1 osmid=2",), ("osmid=2",)], "value string")
    audited = export.audit(nodes, export.ids_in_text(lines))
    assert tuple(audited.first()) == (3, 2, 1)
    with pytest.raises(ValueError, match="1 of 3"):
        export.check_audit(audited)


def test_shown_forms(spark):
    df = spark.createDataFrame([("Foo (a, b , ,c)", 999.4, 0.9991), ("Bar", 9_949.0, 0.5), ("X (y) (q)", None, 1.0)], "d string, m double, s double")
    rows = df.select(present.primary_name(F.col("d")), present.address_parts(F.col("d")), present.distance_label(F.col("m")), present.score_label(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("Foo", ["a", "b", "c"], "999 m", "1.00"), ("Bar", [], "9.9 km", "0.50"), ("X", ["y) (q"], None, "1.00")]
    line = df.limit(1).select(present.hit_line(F.col("s"), F.lit(2), F.lit("N"), F.array(F.lit("a"), F.lit("b")), F.lit(49.0), F.lit(24.0), F.lit(1500.0))).first()[0]
    assert line == "1.00  ex:2  N  (a, b)  geo:49.00000,24.00000  1.5 km"


def test_asof_and_debounce(spark):
    q = spark.createDataFrame([(1, at(5), 50), (1, at(1), 51), (2, at(9), 52)], "user_id long, ts timestamp, event_id long")
    f = spark.createDataFrame([(1, at(5), 7, 0.5), (1, at(2), 6, 0.2)], "user_id long, ts timestamp, fix_id long, value double")
    got = {r["event_id"]: r["origin"] and r["origin"]["fix_id"] for r in origin.asof_origin(q, f).collect()}
    assert got == {50: 7, 51: None, 52: None}
    typed = spark.createDataFrame([(1, at(0), 1), (1, at(0.1), 2), (1, at(1), 3)], "user_id long, ts timestamp, event_id long")
    assert sorted(r["event_id"] for r in origin.debounced(typed, "250 milliseconds").collect()) == [2, 3]


def run_stream(spark, tmp_path, df, make, mode):
    folder = tmp_path / "in"
    for k, part in enumerate(df):
        part.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(df[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = make(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.sql("select * from out").collect()


def test_stream_debounce(spark, tmp_path):
    rows = spark.createDataFrame([(1, at(0), "m"), (1, at(0.1), "me"), (1, at(0.2), "med"), (1, at(5), "x"), (2, at(60), "end")], "user_id long, ts timestamp, text string")
    got = run_stream(spark, tmp_path, [rows], lambda s: events.debounced(s, late="1 second"), "append")
    assert sorted(r["text"] for r in got) == ["med", "x"]


def test_stream_origin(spark, tmp_path):
    schema = "user_id long, ts timestamp, kind string, lat double, lon double"
    rows = spark.createDataFrame([(1, at(0), "gps", 1.0, 1.0), (1, at(1), "place", 2.0, 2.0), (1, at(2), "gps", 3.0, 3.0), (2, at(0), "gps", 4.0, 4.0)], schema)
    got = {r["user_id"]: (r["kind"], r["lat"]) for r in run_stream(spark, tmp_path, [rows], events.origin_changes, "update")}
    assert got == {1: ("place", 2.0), 2: ("gps", 4.0)}


def test_stream_origin_forgets_and_ignores_stale_events(spark, tmp_path):
    schema = "user_id long, ts timestamp, kind string, lat double, lon double"
    parts = [[(1, at(100), "map", 2.0, 2.0)], [(1, at(95), "place", 1.0, 1.0), (2, at(110), "gps", 5.0, 5.0)], [(3, at(9_000), "gps", 0.0, 0.0)], [(3, at(9_001), "gps", 0.0, 0.0)], [(1, at(9_002), "gps", 7.0, 7.0)]]
    frames = [spark.createDataFrame(rows, schema) for rows in parts]
    got = [(r["user_id"], r["kind"], r["lat"], r["changed"]) for r in run_stream(spark, tmp_path, frames, lambda s: events.origin_changes(s, keep_ms=60_000), "update")]
    assert [x for x in got if x[0] == 1] == [(1, "map", 2.0, True), (1, "map", 2.0, False), (1, "gps", 7.0, True)]


def test_stream_query_gets_its_last_fix(spark, tmp_path):
    schema = "user_id long, ts timestamp, kind string, lat double, lon double, text string"
    rows = [(1, at(1), "gps", 1.0, 1.0, None), (1, at(4), "gps", 2.0, 2.0, None), (1, at(5), "query", None, None, "a"), (1, at(6), "gps", 3.0, 3.0, None), (2, at(5), "query", None, None, "b"), (9, at(90_000), "query", None, None, "end"), (9, at(90_000), "gps", 0.0, 0.0, None)]
    split = lambda s: events.with_origin(s.where("kind = 'query'").select("user_id", "ts", "text"), s.where("kind = 'gps'").select("user_id", "ts", "lat", "lon"))
    got = {r["text"]: r["fix_lat"] for r in run_stream(spark, tmp_path, [spark.createDataFrame(rows, schema)], split, "append")}
    assert got == {"a": 2.0, "b": None}


def test_a_moved_origin_searches_again(spark, tmp_path):
    schema = "user_id long, ts timestamp, kind string, lat double, lon double, text string"
    rows = [(1, at(1), "query", None, None, "inn"), (1, at(2), "gps", 1.0, 1.0, None), (1, at(3), "gps", 1.0, 1.0, None), (1, at(4), "place", 2.0, 2.0, None), (1, at(5), "gps", 9.0, 9.0, None), (2, at(1), "gps", 4.0, 4.0, None), (2, at(2), "query", None, None, "bar"), (3, at(1), "query", None, None, " ")]
    got = sorted((r["user_id"], r["text"], r["kind"], r["reason"]) for r in run_stream(spark, tmp_path, [spark.createDataFrame(rows, schema)], events.searches, "append"))
    assert got == [(1, "inn", "gps", "moved"), (1, "inn", "none", "typed"), (1, "inn", "place", "moved"), (2, "bar", "gps", "typed")]
    asked = spark.createDataFrame([(1, at(1), 10, "inn"), (1, at(90_000), 11, "bar"), (2, at(1), 12, " ")], "user_id long, ts timestamp, query_id long, text string")
    changes = spark.createDataFrame([(1, at(0), 1), (1, at(2), 2), (1, at(80_000), 3), (1, at(200_000), 4), (2, at(2), 5)], "user_id long, ts timestamp, change_id long")
    assert {(r["change_id"], r["query"]["query_id"]) for r in origin.reruns(changes, asked).collect()} == {(2, 10), (3, 10), (4, 11)}
    fixes = spark.createDataFrame([(1, at(0), 1, 48.0, 24.0), (1, at(5), 2, 48.0, 24.00001), (1, at(90_000), 3, 48.0, 24.00002), (1, at(90_001), 4, 48.1, 24.0)], "user_id long, ts timestamp, fix_id long, lat double, lon double")
    assert sorted(r["fix_id"] for r in origin.moved(fixes, 100.0).collect()) == [1, 4]


def test_each_batch_answers_the_newest_query(spark):
    seen = []
    run = events.answer_each_batch(lambda q: q, lambda df, n: seen.append((n, sorted(r["query_id"] for r in df.collect()))))
    run(spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 3, "c")], "user_id long, query_id long, text string"), 4)
    assert seen == [(4, [3, 11])]
