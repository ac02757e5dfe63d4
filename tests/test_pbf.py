"""The .pbf source against files written here."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from waymark.sources import osm
from waymark.sources import pbf
from waymark.sources.pbf import packed, read_pbf, read_rows, signed


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


zigzag = lambda n: (n << 1) ^ (n >> 63)
field = lambda k, v: varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v)
pack = lambda values: b"".join(map(varint, values))


def deltas(values):
    return pack(zigzag(b - a) for a, b in zip([0, *values], values, strict=False))


def blob(kind, data, compressed=True):
    body = field(3, zlib.compress(data)) + field(2, len(data)) if compressed else field(1, data)
    header = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(header)) + header + body


def test_numbers():
    values = [0, -1, 1, 63, -64, 300, -(2**40), 2**62]
    assert signed(packed(pack(map(zigzag, values)))).tolist() == values
    assert packed(b"").tolist() == []


def test_round_trip(spark, tmp_path):
    strings = ["", "name", "Київ", "highway", "road", "outer", "type", "multipolygon"]
    table = field(1, b"".join(field(1, s.encode()) for s in strings))
    ids, lats, lons = [5, 3, 1000], [500000000, -10000000, 0], [305000000, 240000000, -1]
    dense = field(2, field(1, deltas(ids)) + field(8, deltas(lats)) + field(9, deltas(lons)) + field(10, pack([1, 2, 0, 0, 3, 4, 1, 2, 0])))
    plain = field(1, field(1, zigzag(-7)) + field(8, zigzag(-5)) + field(9, zigzag(6)) + field(2, pack([1])) + field(3, pack([4])))
    way = field(3, field(1, 9) + field(2, pack([3, 1])) + field(3, pack([4, 2])) + field(8, deltas([5, 3, 1000, 5])))
    relation = field(4, field(1, 11) + field(2, pack([6])) + field(3, pack([7])) + field(8, pack([5, 0])) + field(9, deltas([9, 5])) + field(10, pack([1, 0])))
    data = blob(b"OSMHeader", b"") + blob(b"OSMData", table + field(2, dense)) + blob(b"OSMData", table + field(2, plain + way + relation) + field(17, 1000) + field(19, -2000), False)
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(data)
    nodes, ways, relations = read_pbf(spark, str(path))
    got = {r["id"]: (round(r["lon"], 9), round(r["lat"], 9), [tuple(t) for t in r["tags"]]) for r in nodes.collect()}
    assert got == {5: (30.5, 50.0, [("name", "Київ")]), 3: (24.0, -1.0, []), 1000: (-1e-07, 0.0, [("highway", "road"), ("name", "Київ")]), -7: (6e-06, -7e-06, [("name", "road")])}
    assert tuple(ways.first()) == (9, [5, 3, 1000, 5], [("highway", "road"), ("name", "Київ")])
    assert tuple(relations.first()) == (11, [("way", 9, "outer"), ("node", 5, "")], [("type", "multipolygon")])
    assert {(r["osm_type"], r["osm_id"]) for r in osm.objects(nodes, ways, relations).collect()} == {("n", 5), ("n", 1000), ("n", -7), ("w", 9), ("a", 18)}
    assert np.isclose(osm.objects(nodes, ways, relations).where("osm_id = 5").first()["lat"], 50.0)


def test_no_data(spark, tmp_path):
    path = tmp_path / "e.osm.pbf"
    path.write_bytes(blob(b"OSMHeader", b""))
    assert read_pbf(spark, str(path))[0].count() == 0


def extract(blocks, nodes, named=1):
    """A file of dense blocks, the first ``named`` with names, then a block of ways and one of relations."""
    strings = ["", "name", "Hill", "type", "boundary", "building", "yes"]
    texts = lambda used: field(1, b"".join(field(1, s.encode()) for s in strings[:used]))
    data = blob(b"OSMHeader", b"")
    for b in range(blocks):
        ids = list(range(b * nodes, (b + 1) * nodes))
        tags = [t for k in ids for t in ([1, 2, 0] if k % 10 == 0 else [0])] if b < named else []
        dense = field(1, deltas(ids)) + field(8, deltas([k % 1000 for k in ids])) + field(9, deltas([-k for k in ids])) + field(10, pack(tags))
        data += blob(b"OSMData", texts(3 if b < named else 1) + field(2, field(2, dense)))
    ways = b"".join(field(3, field(1, k) + field(2, pack([1 if k % 2 else 5])) + field(3, pack([2 if k % 2 else 6])) + field(8, deltas([k, k + 1, 0]))) for k in range(1, 7))
    relations = b"".join(field(4, field(1, k) + field(2, pack([3])) + field(3, pack([4])) + field(8, pack([0])) + field(9, deltas([k])) + field(10, pack([1]))) for k in range(3))
    return data + blob(b"OSMData", texts(7) + field(2, ways)) + blob(b"OSMData", texts(5) + field(2, relations))


def test_only_what_is_asked_for_is_decoded(monkeypatch, tmp_path):
    path = tmp_path / "p.osm.pbf"
    path.write_bytes(extract(4, 50))
    seen = []
    for name in ("dense", "plain", "refs", "members"):
        monkeypatch.setattr(pbf.Block, name, lambda self, *a, _n=name, _f=getattr(pbf.Block, name): seen.append(_n) or _f(self, *a))

    def read(columns, filters=(), **options):
        seen.clear()
        reader = pbf.PbfReader(str(path), 2, columns, **options)
        rest = list(reader.pushFilters(list(filters)))
        rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        return rows, rest

    rows, rest = read(["id", "refs"], [pbf.EqualTo(("kind",), "way"), pbf.EqualTo(("id",), 1)])
    assert [r["refs"] for r in rows] == [[k, k + 1, 0] for k in range(1, 7)] and seen == ["plain", "refs"] and rest == [pbf.EqualTo(("id",), 1)]
    rows, _ = read(["kind", "id"], [pbf.In(("kind",), ("node", "relation"))])
    assert len(rows) == 203 and sorted(seen) == ["dense"] * 4 + ["plain"]
    assert read(["id"], [pbf.EqualTo(("kind",), "node"), pbf.EqualTo(("kind",), "way")])[0] == [] == seen
    # Of six blocks, three have the key among their texts; no relation holds it.
    rows, _ = read(["kind", "id", "tags"], key="name", keyed=True)
    assert [(r["kind"], r["id"]) for r in rows] == [*(("node", k) for k in range(0, 50, 10)), ("way", 1), ("way", 3), ("way", 5)] and seen == ["dense", "plain", "plain"]
    assert all(r["tags"] == [{"k": "name", "v": "Hill"}] for r in rows)
    rows, _ = read(["kind", "id", "tags"], key="name")
    assert len(rows) == 209 and sum(bool(r["tags"]) for r in rows) == 8


def test_filters_reach_the_scan(spark, tmp_path):
    path = tmp_path / "p.osm.pbf"
    path.write_bytes(extract(3, 40))
    nodes, ways, relations = read_pbf(spark, str(path))
    assert (nodes.count(), ways.count(), relations.count()) == (120, 6, 3)
    assert [(r["id"], round(r["lon"], 9), [tuple(t) for t in r["tags"]]) for r in nodes.where("id = 10").collect()] == [(10, -1e-06, [("name", "Hill")])]
    # Spark keeps no filter on the kind: the source answers for it.
    assert "Filter " not in ways._jdf.queryExecution().executedPlan().toString()
    keyed = read_pbf(spark, str(path), "name", True)
    assert [df.count() for df in keyed] == [4, 3, 0]
    with pytest.raises(Exception, match="keyed needs an option key"):
        spark.read.format("osm_pbf").option("keyed", "true").load(str(path)).count()
    assert read_rows(spark, str(path), ("id",)).schema.names == ["id"]


def test_a_tag_value_that_is_text_zero():
    values = np.array([1, 0, 0, 0, 1, 2, 0], dtype=np.uint64)  # name="" of the first node, none, name=Hill
    texts, offsets = pbf.pairs(values, 3)
    assert texts.tolist() == [1, 0, 1, 2] and offsets.tolist() == [0, 1, 1, 2]
