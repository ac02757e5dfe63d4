"""A source of location fixes: an append-only log, read as a batch or as a stream, with the last known fixes first.

The log is a folder of segments, files of JSON lines (user_id, ts, lat, lon) named in the order in which they were begun;
only the last one grows.  A stream's offset is a segment and a place in it, so offsets stay small whatever the log's
length, a batch can be read again exactly, and a restart from a checkpoint gives each fix once.

:func:`remember` keeps the last fix of each user beside the place in the log that it has seen.  A new stream with the option
``known`` begins with those fixes and goes on from that place, instead of reading the whole log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from waymark.lineage import exists, read_text, remove, replace_text

FIX = "user_id bigint, ts timestamp, lat double, lon double, known boolean"
ARROW = pa.schema([("user_id", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("lat", pa.float64()), ("lon", pa.float64()), ("known", pa.bool_())])
START = {"file": "", "at": 0}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Lines(InputPartition):
    """The lines that begin within [start, end) of a file."""

    def __init__(self, path: str, start: int, end: int, known: bool = False):
        self.path, self.start, self.end, self.known = path, start, end, known


def segments(folder: str) -> list[tuple[str, int]]:
    """(name, size) of the files of a folder in order; what begins with a dot or an underscore is not yet one."""
    store, inner = _store(folder)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def whole_lines(path: str, size: int, piece: int = 1 << 16) -> int:
    """How many of the first ``size`` bytes are whole lines; a line still being written waits for the next batch."""
    store, inner = _store(path)
    with store.open_input_file(inner) as file:
        while size > 0:
            start = max(size - piece, 0)
            file.seek(start)
            if (at := file.read(size - start).rfind(b"\n")) >= 0:
                return start + at + 1
            size = start
    return 0


def log_end(folder: str) -> dict:
    """The place behind the last whole line of the log."""
    files = segments(folder)
    return {"file": files[-1][0], "at": whole_lines(f"{folder}/{files[-1][0]}", files[-1][1])} if files else dict(START)


def between(folder: str, start: dict, end: dict, split: int) -> list[Lines]:
    """The parts of the log from one place to another, each of about ``split`` bytes."""
    parts = []
    for name, size in segments(folder):
        if start["file"] <= name <= end["file"]:
            low, high = start["at"] if name == start["file"] else 0, end["at"] if name == end["file"] else size
            parts += [Lines(f"{folder}/{name}", at, min(at + split, high)) for at in range(low, high, split)]
    return parts


def read_lines(part: Lines) -> Iterator[pa.RecordBatch]:
    """The fixes of a part; a line belongs to the part that it begins in.  Lines without a user, time or place, or that are no JSON, are left out."""
    if part.end <= part.start:
        return
    store, inner = _store(part.path)
    with store.open_input_file(inner) as file:
        file.seek(max(part.start - 1, 0))
        data = file.read(part.end - max(part.start - 1, 0))
        if part.start:  # the byte before tells whether a line begins here
            cut = data.find(b"\n")
            data = data[cut + 1 :] if cut >= 0 else b""
        while data and not data.endswith(b"\n"):
            more = file.read(1 << 12)
            if not more:
                break
            cut = more.find(b"\n")
            data += more[: cut + 1] if cut >= 0 else more
    table = parsed(data)
    if table.num_rows:
        known = pa.array([part.known] * table.num_rows)
        yield from table.append_column("known", known).cast(ARROW).to_batches()


def parsed(data: bytes) -> pa.Table:
    schema = pa.schema([("user_id", pa.int64()), ("ts", pa.timestamp("us")), ("lat", pa.float64()), ("lon", pa.float64())])
    options = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
    try:
        table = pj.read_json(pa.BufferReader(data), parse_options=options) if data.strip() else schema.empty_table()
    except pa.ArrowInvalid:
        # One line spoils a whole part for the fast reader: the lines are read one by one.
        kept = []
        for line in data.splitlines():
            try:
                kept.append(pj.read_json(pa.BufferReader(line), parse_options=options).select(schema.names))
            except pa.ArrowInvalid:
                continue
        table = pa.concat_tables(kept) if kept else schema.empty_table()
    table = table.select(schema.names).drop_null()
    return table.set_column(1, "ts", table["ts"].cast(pa.timestamp("us", tz="UTC")))


class LogReader(DataSourceReader):
    def __init__(self, folder: str, split: int, start: dict, end: dict):
        self.folder, self.split, self.start, self.end = folder, split, start, end

    def partitions(self) -> list[Lines]:
        return between(self.folder, self.start, self.end, self.split) or [Lines(self.folder, 0, 0)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        return read_lines(partition)


class LogStream(DataSourceStreamReader):
    """Offsets: a place in the log, and the folder of last known fixes until those have been given."""

    def __init__(self, folder: str, split: int, known: dict | None):
        self.folder, self.split, self.first = folder, split, known

    def initialOffset(self) -> dict:
        return {**self.first["place"], "known": self.first["folder"]} if self.first else {**START, "known": ""}

    def latestOffset(self) -> dict:
        return {**log_end(self.folder), "known": ""}

    def partitions(self, start: dict, end: dict) -> Iterator[Lines]:
        parts = between(self.folder, start, end, self.split)
        if start["known"] and not end["known"]:
            parts += [Lines(f"{start['known']}/{name}", at, min(at + self.split, size), True) for name, size in segments(start["known"]) for at in range(0, size, self.split)]
        return parts or [Lines(self.folder, 0, 0)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        return read_lines(partition)


class FixLog(DataSource):
    """``spark.read`` or ``spark.readStream`` of format ``fix_log``; ``known`` in the rows marks the last known fixes.

    Options: ``split``, bytes of a part; ``known``, a folder that :func:`remember` keeps (streams only); ``from_file``, ``from_at``,
    ``to_file``, ``to_at``, places in the log (batches only).
    """

    @classmethod
    def name(cls) -> str:
        return "fix_log"

    def schema(self) -> str:
        return FIX

    @property
    def _split(self) -> int:
        return int(self.options.get("split", 64 << 20))

    def reader(self, schema) -> LogReader:
        o, folder = self.options, self.options["path"]
        start = {"file": o.get("from_file", ""), "at": int(o.get("from_at", 0))}
        return LogReader(folder, self._split, start, {"file": o["to_file"], "at": int(o["to_at"])} if "to_file" in o else log_end(folder))

    def streamReader(self, schema) -> LogStream:
        known = self.options.get("known")
        if known:
            store, inner = _store(f"{known}/current")
            if store.get_file_info(inner).type == fs.FileType.NotFound:
                known = None
            else:
                with store.open_input_file(inner) as file:
                    current = json.loads(file.read())
                known = {"place": current["place"], "folder": f"{known}/{current['version']}"}
        return LogStream(self.options["path"], self._split, known)


def read_fixes(spark: SparkSession, folder: str, known: str | None = None, stream: bool = True) -> DataFrame:
    """Fixes (user_id, ts, lat, lon, known) of a log: a stream, or what it holds now."""
    spark.dataSource.register(FixLog)
    reader = (spark.readStream if stream else spark.read).format("fix_log")
    return (reader.option("known", known) if known and stream else reader).load(folder)


def remember(spark: SparkSession, folder: str, known: str) -> dict:
    """Bring the last known fix of each user up to date with the log; returns the place in the log that they cover.

    Only what was added since the last time is read, and one row of each user.  Of equal times the one with the larger place counts.
    A new version is written whole and published by one rename; the one before is kept for streams that begin meanwhile.
    """
    spark.dataSource.register(FixLog)
    old = json.loads(read_text(spark, f"{known}/current")) if exists(spark, f"{known}/current") else None
    end, start = log_end(folder), old["place"] if old else START
    fixes = spark.read.format("fix_log").options(from_file=start["file"], from_at=start["at"], to_file=end["file"], to_at=end["at"]).load(folder).drop("known")
    if old:
        fixes = fixes.unionByName(spark.read.schema("user_id bigint, ts timestamp, lat double, lon double").json(f"{known}/{old['version']}"))
    version = f"v{uuid4().hex}"
    last = fixes.groupBy("user_id").agg(F.max(F.struct("ts", "lat", "lon")).alias("f")).select("user_id", F.date_format(F.to_utc_timestamp("f.ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "f.lat", "f.lon")
    last.write.json(f"{known}/{version}")
    replace_text(spark, f"{known}/current", json.dumps({"version": version, "place": end, "before": old["version"] if old else None}))
    if old and old.get("before"):
        remove(spark, f"{known}/{old['before']}")
    return end
