"""A Spark data source for OpenStreetMap .pbf extracts.

The file is a row of independently compressed blobs.  Only their headers are read to plan the partitions;
each task then seeks to its blobs and decodes the kinds, columns and tags that are asked for, as whole arrays.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType, _parse_datatype_string

ROW = (
    "kind string, id bigint, lon double, lat double, tags array<struct<k: string, v: string>>, refs array<bigint>,"
    " members array<struct<type: string, ref: bigint, role: string>>"
)
_TAG, _MEMBER = pa.struct([("k", pa.string()), ("v", pa.string())]), pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = pa.schema([
    ("kind", pa.string()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", pa.list_(_TAG)), ("refs", pa.list_(pa.int64())), ("members", pa.list_(_MEMBER)),
])
MEMBER_TYPES = ("node", "way", "relation")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: numbers for varints, bytes for anything with a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def packed(data: bytes) -> np.ndarray:
    """The varints of a packed field."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    if not len(ends):
        return np.zeros(0, dtype=np.uint64)
    spot = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * spot).astype(np.uint64)
    return np.add.reduceat(parts, starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Undo zigzag coding."""
    half = (values >> np.uint64(1)).astype(np.int64)
    return np.where(values & np.uint64(1), ~half, half)


def unsigned(value: int) -> int:
    """A plain 64-bit integer field: two's complement."""
    return value - (1 << 64) if value >> 63 else value


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The varints of many packed fields at once, and the offsets at which each field begins."""
    data = b"".join(parts)
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, dtype=np.uint8) < 0x80)])
    return packed(data), ends[np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])]


def running(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of zigzag deltas that begin anew at each offset."""
    sums = np.cumsum(signed(values))
    before = np.concatenate([[0], sums])[offsets[:-1]]
    return sums - np.repeat(before, np.diff(offsets))


def pairs(values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(key and value in turn, offsets of pairs by row) of the tags of dense nodes, which a zero ends for each node."""
    if not len(values):
        return values, np.zeros(rows + 1, dtype=np.int64)
    zeros = np.flatnonzero(values == 0)
    sizes = np.diff(np.concatenate([[-1], zeros])) - 1
    if len(zeros) != rows or (sizes % 2).any():  # a value that is text 0: only the zeros at the place of a key end a node
        ends, at = [], 0
        while at < len(values):
            while values[at]:
                at += 2
            ends.append(at)
            at += 1
        zeros = np.array(ends)
        sizes = np.diff(np.concatenate([[-1], zeros])) - 1
    keep = np.ones(len(values), dtype=bool)
    keep[zeros] = False
    return values[keep], np.concatenate([[0], np.cumsum(sizes // 2)])


class Block:
    """One decompressed block, as columns by kind.

    ``kinds`` are decoded, others passed over unread.  With a ``key``, only objects that hold it carry tags, and a block
    whose texts lack it has none decoded; ``keyed`` leaves the other objects out altogether.
    """

    def __init__(self, data: bytes, wanted: list[str], kinds: frozenset[str] = frozenset(MEMBER_TYPES), key: str | None = None, keyed: bool = False):
        self.wanted, self.kinds, self.keyed = wanted, kinds, keyed
        self.groups, self.granularity, self.lat0, self.lon0 = [], 100, 0, 0
        texts: bytes = b""
        for number, value in fields(data):
            if number == 1:
                texts = value
            elif number == 2:
                self.groups.append(value)
            elif number == 17:
                self.granularity = value
            elif number == 19:
                self.lat0 = unsigned(value)
            elif number == 20:
                self.lon0 = unsigned(value)
        self.keys = None
        if key is not None:
            # Most blocks of untagged nodes end here: the bytes of the key are nowhere among the texts.
            sought = key.encode()
            self.keys = [at for at, (_, v) in enumerate(fields(texts)) if v == sought] if sought in texts else []
        self.texts, self._strings = texts, None

    @property
    def strings(self) -> pa.Array:
        if self._strings is None:
            self._strings = pa.array([v.decode("utf-8", "replace") for n, v in fields(self.texts) if n == 1], pa.string())
        return self._strings

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.keyed and not self.keys:
            return
        for group in self.groups:
            found: dict[int, list[bytes]] = {}
            for number, value in fields(group):
                found.setdefault(number, []).append(value)
            for number, messages in found.items():
                if number not in (1, 2, 3, 4) or MEMBER_TYPES[max(number - 2, 0)] not in self.kinds:
                    continue
                if number == 2:
                    for message in messages:
                        yield from self.dense(dict(fields(message)))
                else:
                    yield from self.plain(number, [dict(fields(m)) for m in messages])

    def dense(self, own: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        of = lambda k: np.cumsum(signed(packed(own.get(k, b""))))
        ids, spot = of(1), {"lon": lambda: self.degrees(of(9), self.lon0), "lat": lambda: self.degrees(of(8), self.lat0)}
        texts, offsets = pairs(packed(own.get(10, b"")), len(ids)) if self.tagged else (None, None)
        yield from self.batch("node", ids, spot, (texts[0::2], texts[1::2], offsets) if self.tagged else None)

    def plain(self, number: int, own: list[dict]) -> Iterator[pa.RecordBatch]:
        tags = None
        if self.tagged:
            (ks, offsets), (vs, _) = joined([m.get(2, b"") for m in own]), joined([m.get(3, b"") for m in own])
            tags = ks, vs, offsets
        if number == 1:
            of = lambda k: signed(np.array([m[k] for m in own], dtype=np.uint64))
            yield from self.batch("node", of(1), {"lon": lambda: self.degrees(of(9), self.lon0), "lat": lambda: self.degrees(of(8), self.lat0)}, tags)
            return
        ids = np.array([unsigned(m[1]) for m in own], dtype=np.int64)
        if number == 3:
            yield from self.batch("way", ids, {"refs": lambda: self.refs([m.get(8, b"") for m in own])}, tags)
        else:
            yield from self.batch("relation", ids, {"members": lambda: self.members(own)}, tags)

    @property
    def tagged(self) -> bool:
        """Whether tags are to be read at all."""
        return "tags" in self.wanted and self.keys != [] or self.keyed

    def degrees(self, raw: np.ndarray, start: int) -> pa.Array:
        return pa.array((start + self.granularity * raw) * 1e-9)

    def refs(self, parts: list[bytes]) -> pa.Array:
        values, offsets = joined(parts)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(running(values, offsets)))

    def members(self, own: list[dict]) -> pa.Array:
        refs, offsets = joined([m.get(9, b"") for m in own])
        kinds, roles = (joined([m.get(k, b"") for m in own])[0].astype(np.int64) for k in (10, 8))
        parts = [pa.array(MEMBER_TYPES, pa.string()).take(pa.array(kinds)), pa.array(running(refs, offsets)), self.strings.take(pa.array(roles))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_MEMBER)))

    def batch(self, kind: str, ids: np.ndarray, own: dict, tags: tuple | None) -> Iterator[pa.RecordBatch]:
        """The wanted columns of rows of one kind; ``own`` are functions, so that what is not wanted is not decoded."""
        rows, holds = len(ids), None
        if tags and self.keys is not None:
            ks, vs, offsets = tags
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(rows), sizes)
            holds = np.bincount(owner[np.isin(ks, self.keys)], minlength=rows) > 0
            of_holder = holds[owner]
            tags = ks[of_holder], vs[of_holder], np.concatenate([[0], np.cumsum(np.where(holds, sizes, 0))])
        if rows == 0 or (self.keyed and not holds.any()):
            return

        def column(field: pa.Field) -> pa.Array:
            if field.name == "kind":
                return pa.repeat(pa.scalar(kind), rows)
            if field.name == "id":
                return pa.array(ids)
            if field.name == "tags":
                ks, vs, offsets = tags or (np.zeros(0), np.zeros(0), np.zeros(rows + 1))
                texts = [self.strings.take(pa.array(a.astype(np.int64))) for a in (ks, vs)] if len(ks) else [pa.array([], pa.string())] * 2
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(texts, fields=list(_TAG)))
            return own[field.name]() if field.name in own else pa.nulls(rows, field.type)

        schema = pa.schema([ARROW.field(name) for name in self.wanted])
        made = pa.RecordBatch.from_arrays([column(f).cast(f.type) for f in schema], schema=schema)
        yield made.filter(pa.array(holds)) if self.keyed else made


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


class Blobs(InputPartition):
    def __init__(self, spots: list[tuple[int, int]]):
        self.spots = spots


class PbfReader(DataSourceReader):
    def __init__(self, path: str, at_once: int, wanted: list[str], key: str | None = None, keyed: bool = False):
        self.path, self.at_once, self.wanted, self.key, self.keyed = path, at_once, wanted, key, keyed
        self.kinds = frozenset(MEMBER_TYPES)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the kind decide which groups are decoded; Spark applies all the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds &= frozenset(f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute in (("kind",), ("id",))):  # these never are
                yield f

    def partitions(self) -> list[Blobs]:
        if not self.kinds:
            return [Blobs([])]
        spots = []
        with _opened(self.path) as file:
            size, at = file.size(), 0
            while at < size:
                file.seek(at)
                length = struct.unpack(">I", file.read(4))[0]
                header = dict(fields(file.read(length)))
                if header[1] == b"OSMData":
                    spots.append((at + 4 + length, header[3]))
                at += 4 + length + header[3]
        return [Blobs(spots[k : k + self.at_once]) for k in range(0, len(spots), self.at_once)] or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if not partition.spots:
            return
        with _opened(self.path) as file:
            for at, size in partition.spots:
                file.seek(at)
                blob = dict(fields(file.read(size)))
                data = blob[1] if 1 in blob else zlib.decompress(blob[3])
                yield from Block(data, self.wanted, self.kinds, self.key, self.keyed).batches()


class PbfSource(DataSource):
    """``spark.read.format("osm_pbf").load(path)``; only the columns of a given schema are decoded.

    Options: ``blobs``, how many blobs a task reads; ``key``, a tag key without which objects come without tags;
    ``keyed`` (true or false), whether such objects are left out.  Needs ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> PbfReader:
        keyed = str(self.options.get("keyed", "false")).lower() == "true"
        if keyed and "key" not in self.options:
            raise ValueError("option keyed needs an option key")
        return PbfReader(self.options["path"], int(self.options.get("blobs", 8)), schema.names, self.options.get("key"), keyed)


def read_rows(spark: SparkSession, path: str, columns: tuple[str, ...] = (), key: str | None = None, keyed: bool = False) -> DataFrame:
    """Rows of a .pbf extract, of every kind: all columns or the given ones, with the options of :class:`PbfSource`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PbfSource)
    whole = _parse_datatype_string(ROW)
    reader = spark.read.format("osm_pbf").schema(StructType([whole[c] for c in columns or whole.names]))
    if key is not None:
        reader = reader.option("key", key).option("keyed", keyed)
    return reader.load(path)


def read_pbf(spark: SparkSession, path: str, key: str | None = None, keyed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of a .pbf extract; each scans the file for its kind and columns, ``osm.read_once`` does so once."""
    of = lambda kind, *columns: read_rows(spark, path, ("kind", "id", *columns, "tags"), key, keyed).where(F.col("kind") == kind).select("id", *columns, "tags")
    return of("node", "lon", "lat"), of("way", "refs"), of("relation", "members")
