"""The log of fixes as a batch and as a stream: places, restarts, last known fixes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from waymark.sources import fixes


def line(user, second, lat=1.0, lon=2.0):
    return json.dumps({"user_id": user, "ts": f"2024-01-01T00:00:{second:02d}Z", "lat": lat, "lon": lon, "provider": "gps"}) + "\n"


def append(folder, name, text):
    with open(folder / name, "a") as file:
        file.write(text)


def drain(spark, folder, checkpoint, out, known=None):
    """Run a stream to the end of the log as it is, and return all rows that have ever reached the sink."""
    query = fixes.read_fixes(spark, str(folder), known and str(known)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(str(out)).select("user_id", F.second("ts").alias("s"), "lat", "known").collect()
    return sorted((r["user_id"], r["s"], r["lat"], r["known"]) for r in rows)


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_any_split_gives_each_line_once(log):
    text = "".join(line(k, k % 60, k / 7) for k in range(40))
    append(log, "000", text)
    append(log, "001", line(100, 1))
    for split in (1, 7, 90, 91, 1000, 1 << 20):
        reader = fixes.LogReader(str(log), split, fixes.START, fixes.log_end(str(log)))
        got = [r["user_id"] for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        assert got == [*range(40), 100]


def test_bad_lines_and_empty_logs(spark, log):
    assert fixes.read_fixes(spark, str(log), stream=False).count() == 0
    append(log, "000", line(1, 1) + "\n{broken\n" + '{"user_id": null, "ts": "2024-01-01T00:00:01Z", "lat": 1, "lon": 1}\n{"user_id": 3}\n' + line(2, 2))
    append(log, "_001", line(9, 9))
    rows = fixes.read_fixes(spark, str(log), stream=False).select("user_id", F.date_format("ts", "HH:mm:ss").alias("t")).collect()
    assert sorted(map(tuple, rows)) == [(1, "00:00:01"), (2, "00:00:02")]


def test_a_restart_gives_each_fix_once(spark, log, tmp_path):
    append(log, "000", line(1, 1) + line(2, 2) + line(3, 3)[:20])  # the third line is still being written
    run = lambda: [r[:2] for r in drain(spark, log, tmp_path / "c", tmp_path / "out")]
    assert run() == [(1, 1), (2, 2)]
    append(log, "000", line(3, 3)[20:] + line(1, 4))
    append(log, "001", line(4, 5))
    assert run() == [(1, 1), (1, 4), (2, 2), (3, 3), (4, 5)]
    assert run() == [(1, 1), (1, 4), (2, 2), (3, 3), (4, 5)]


def test_last_known_fixes_come_first(spark, log, tmp_path):
    known = tmp_path / "known"
    append(log, "000", line(1, 1, 0.1) + line(1, 5, 0.5) + line(2, 2, 0.2) + line(1, 3, 0.3))
    place = fixes.remember(spark, str(log), str(known))
    assert place == {"file": "000", "at": len(line(1, 1)) * 4}
    append(log, "000", line(2, 9, 0.9))
    append(log, "001", line(3, 7, 0.7))
    # Last known: user 1 at 5, user 2 at 2; then only what the log has gained since.
    first = drain(spark, log, tmp_path / "c1", tmp_path / "o1", known)
    assert first == [(1, 5, 0.5, True), (2, 2, 0.2, True), (2, 9, 0.9, False), (3, 7, 0.7, False)]
    # A restart from the checkpoint knows that they were given, although they have moved on since.
    fixes.remember(spark, str(log), str(known))
    append(log, "001", line(1, 11, 1.1))
    assert drain(spark, log, tmp_path / "c1", tmp_path / "o1", known) == sorted([*first, (1, 11, 1.1, False)])
    assert drain(spark, log, tmp_path / "c2", tmp_path / "o2", known) == [(1, 5, 0.5, True), (1, 11, 1.1, False), (2, 9, 0.9, True), (3, 7, 0.7, True)]
    fixes.remember(spark, str(log), str(known))
    assert len([p for p in known.iterdir() if p.is_dir()]) == 2  # the version in use and the one before
