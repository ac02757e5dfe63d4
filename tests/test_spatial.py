"""Spatial joins and context against brute force and the rules' edges."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import context, ingest, spatial
from waymark.schema import OSM_OBJECT, ContextParams

LAT = 48.8


def east(metres, lon=23.4):
    return lon + metres / (111_320.0 * math.cos(math.radians(LAT)))


def places(spark, rows=((1, "Hotel", 23.4, LAT, ""),)):
    return spark.createDataFrame(list(rows), "place_id long, name string, lon double, lat double, addr_street string")


def points(spark, rows):
    return spark.createDataFrame([(k, n, r, x, y) for k, (n, r, x, y) in enumerate(rows)], "seq long, name string, rank string, lon double, lat double")


def names(df):
    return [r["name"] for r in df.orderBy("place_id", "pos").collect()]


def test_settlement_radius_and_cap(spark):
    near = points(spark, [("in", "village", east(11_900), LAT), ("out", "village", east(12_100), LAT)])
    assert names(spatial.nearby_settlements(places(spark), near)) == ["in"]
    four = points(spark, [(f"v{k}", "hamlet", east(1000 * k), LAT) for k in (4, 2, 3, 1)])
    assert names(spatial.nearby_settlements(places(spark), four)) == ["v1", "v2", "v3"]


def test_fallback_town_only_when_nothing_is_near(spark):
    far = [("town", "town", east(39_000), LAT), ("village", "village", east(20_000), LAT), ("city", "city", east(41_000), LAT)]
    assert names(spatial.nearby_settlements(places(spark), points(spark, far))) == ["town"]
    assert names(spatial.nearby_settlements(places(spark), points(spark, [*far, ("hamlet", "hamlet", east(10), LAT)]))) == ["hamlet"]


def test_subdivision_and_street_radius(spark):
    sub = points(spark, [("in", "suburb", east(1_400), LAT), ("out", "quarter", east(1_600), LAT)])
    assert names(spatial.nearest_subdivision(places(spark), sub)) == ["in"]
    line = lambda m: [(east(m), LAT - 0.01), (east(m), LAT + 0.01)]
    streets = spark.createDataFrame([(1, "out", line(121)), (2, "in", line(119))], "seq long, name string, line array<struct<lon: double, lat: double>>")
    assert [r["name"] for r in spatial.nearest_street(places(spark), streets).collect()] == ["in"]


def square(x0, y0, x1, y1):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]


def areas(spark, rows):
    return spark.createDataFrame(rows, "seq long, name string, level string, polys array<array<array<struct<lon: double, lat: double>>>>")


def test_border_and_first_area(spark):
    rows = [(2, "second", "8", square(23.4, 48, 24, 49)), (1, "first", "8", square(23, 48, 23.4, 49)), (3, "six", "6", square(20, 40, 30, 50)), (4, "no", "7", square(23.41, 48, 24, 49))]
    got = {r["level"]: r["name"] for r in spatial.areas_of(places(spark), areas(spark, rows)).collect()}
    assert got == {"8": "first", "6": "six"}


def test_hole_is_outside(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    rows = areas(spark, [(1, "ring", "4", [[ring(0.0, 10.0), ring(4.0, 6.0)]])])
    at = places(spark, [(1, "a", 5.0, 5.0, ""), (2, "b", 2.0, 2.0, ""), (3, "c", 4.0, 5.0, "")])
    assert {r["place_id"] for r in spatial.areas_of(at, rows, 2.0).collect()} == {2, 3}


def test_context_order_cap_and_own_name(spark):
    settled = points(spark, [("Hotel", "village", east(100), LAT), ("A", "village", east(200), LAT), ("B", "town", east(300), LAT), ("Sub", "suburb", east(50), LAT)])
    admin = areas(spark, [(k, f"L{level}", level, square(20, 40, 30, 50)) for k, level in enumerate(("4", "6", "7", "8"))])
    none = spark.createDataFrame([], "seq long, name string, line array<struct<lon: double, lat: double>>")
    got = context.context(places(spark, [(1, "Hotel", 23.4, LAT, "Main St")]), admin, settled, none).first()["context"]
    assert got == ["A", "B", "Main St", "Sub", "L8", "L7"]
    assert context.context(places(spark), admin.limit(0), settled.limit(0), none).first()["context"] == []


def test_cells_equal_brute_force(spark):
    rng = random.Random(5)
    at = [(k, "p", rng.uniform(22, 24), rng.uniform(48, 50), "") for k in range(150)]
    to = [(f"s{k}", "village", rng.uniform(22, 24), rng.uniform(48, 50)) for k in range(80)]
    want = set()
    for k, _, x, y, _ in at:
        by = sorted((math.hypot((sx - x) * 111_320 * math.cos(math.radians(y)), (sy - y) * 110_574), n) for n, _, sx, sy in to)
        want |= {(k, n) for d, n in by if d <= 20_000}
    got = spatial.nearest(places(spark, at), points(spark, to), 20_000.0, 100)
    assert {(r["place_id"], r["name"]) for r in got.collect()} == want


@pytest.mark.parametrize("lat", [0.01, -60.0, 78.2, 89.5])
def test_cells_hold_at_any_latitude(spark, lat):
    rng = random.Random(int(lat))
    width = 0.6 / max(math.cos(math.radians(lat)), 0.01)
    at = [(k, "p", rng.uniform(20, 20 + width), lat + rng.uniform(-0.3, 0.3), "") for k in range(80)]
    to = [(f"s{k}", "village", rng.uniform(20, 20 + width), lat + rng.uniform(-0.3, 0.3)) for k in range(80)]
    metres = lambda x, y, sx, sy: math.hypot((sx - x) * 111_320 * math.cos(math.radians(y)), (sy - y) * 110_574)
    want = {(k, n) for k, _, x, y, _ in at for n, _, sx, sy in to if metres(x, y, sx, sy) <= 12_000}
    got = spatial.nearest(places(spark, at), points(spark, to), 12_000.0, 100)
    assert want and {(r["place_id"], r["name"]) for r in got.collect()} == want
    lines = [(k, n, [(sx, sy), (sx + 0.01, sy + 0.002)]) for k, (n, _, sx, sy) in enumerate(to)]
    streets = spark.createDataFrame(lines, "seq long, name string, line array<struct<lon: double, lat: double>>")

    def nearest(x, y):
        out = []
        for k, n, ((ax, ay), (bx, by)) in lines:
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            out.append((metres(x, y, ax + t * (bx - ax), ay + t * (by - ay)), k, n))
        return min(out)

    found = {r["place_id"]: r["name"] for r in spatial.nearest_street(places(spark, at), streets, 3_000.0).collect()}
    best = {k: nearest(x, y) for k, _, x, y, _ in at}
    assert found == {k: n for k, (d, _, n) in best.items() if d <= 3_000}


@pytest.mark.parametrize("cell_size", [0.1, 0.25, 3.0])
def test_tiles_equal_the_polygons(spark, cell_size):
    """Stars with holes, cut into tiles, against even-odd counting over whole polygons; most tiles carry no geometry."""
    rng = random.Random(6)

    def star(x, y, radius, corners=24):
        ring = [(x + radius * rng.uniform(0.6, 1) * math.cos(2 * math.pi * k / corners), y + radius * rng.uniform(0.6, 1) * math.sin(2 * math.pi * k / corners)) for k in range(corners)]
        return [*ring, ring[0]]

    shapes = [(k, f"a{k}", str(k), [[star(x, y, 1.5), star(x, y, 0.5)], [star(x + 4, y, 0.7)]]) for k, (x, y) in enumerate([(0.1, 0.2), (1.0, -0.5), (-2.2, 0.7)])]
    at = [(k, "p", rng.uniform(-4, 6), rng.uniform(-2.5, 2.5), "") for k in range(600)]

    def inside(x, y, polys):
        odd = False
        for ring in (r for poly in polys for r in poly):
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return odd

    want = {(k, level) for k, _, x, y, _ in at for _, _, level, polys in shapes if inside(x, y, polys)}
    assert {(r["place_id"], r["level"]) for r in spatial.areas_of(places(spark, at), areas(spark, shapes), cell_size).collect()} == want
    tiles = spatial.area_tiles(areas(spark, shapes), cell_size).collect()
    assert all((r["edges"] is None) == r["whole"] for r in tiles) and (cell_size > 0.1 or sum(r["whole"] for r in tiles) > len(tiles) / 4)


def test_centroids(spark):
    df = spark.createDataFrame([(square(0.0, 0.0, 2.0, 4.0), [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)])], "polys array<array<array<struct<lon: double, lat: double>>>>, line array<struct<lon: double, lat: double>>")
    row = df.select(geo.polygons_centroid(F.col("polys")).alias("p"), geo.line_centroid(F.col("line")).alias("l")).first()
    assert tuple(row["p"]) == (1.0, 2.0) and tuple(row["l"]) == (1.5, 0.5)


def test_ingest_rules(spark):
    node = lambda k, tags, kind="n": (kind, k, k, tags, 23.0, 48.0, None, None)
    rows = [
        node(1, [("name", "  A \n B "), ("building", "yes"), ("shop", "x=y")]), node(2, [("name", " "), ("shop", "x")]),
        node(3, [("name", "C"), ("building", "yes")]), node(4, [("name", "D"), ("foo", "bar")]), node(5, [("name", "E"), ("place", "town")]),
        node(6, [("name", "F"), ("highway", "service")], "w"),
    ]
    objects = ingest.named(spark.createDataFrame(rows, OSM_OBJECT))
    got = {r["osm_id"]: (r["name"], r["c"]) for r in objects.withColumn("c", ingest.category(F.col("tags"))).collect()}
    assert got == {1: ("A B", "shop=x=y"), 3: ("C", "building=yes"), 4: ("D", None), 5: ("E", "place=town"), 6: ("F", None)}
    admin, settled, streets = ingest.roles(objects)
    assert (admin.count(), [r["rank"] for r in settled.collect()], streets.count()) == (0, ["town"], 0)
    assert ingest.located(objects).count() == 4
    assert ingest.in_box(ingest.located(objects), (23.0, 48.0, 23.0, 48.0)).count() == 4


def test_name_variants(spark):
    tags = [("name:uk", "Київ"), ("name", "Kyiv"), ("alt_name", "KYIV"), ("alt_name:ru", " Киев ")]
    df = spark.createDataFrame([(1, tags)], "place_id long, tags array<struct<k: string, v: string>>")
    rows = ingest.name_variants(df).orderBy("ord").collect()
    assert [(r["source"], r["name"]) for r in rows] == [("name", "Kyiv"), ("name:uk", "Київ"), ("alt_name:ru", "Киев"), ("translit_naive", "kiiv"), ("translit_kmu", "kyev"), ("translit_naive", "kiev")]
    assert ContextParams().parts == 6
