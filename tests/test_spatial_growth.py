"""Spatial joins whose work does not follow the radius, and areas counted from an origin."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from waymark.functions.lines import nearest_lines
from waymark.operators import spatial
from waymark.plans.queries import QUERIES

PLACE = "place_id long, name string, lon double, lat double, addr_street string"
POINT = "seq long, name string, lon double, lat double"


def metres(x, y, sx, sy):
    return math.hypot((sx - x) * 111_320 * math.cos(math.radians(y)), (sy - y) * 110_574)


def test_dense_points_need_few_candidates(spark, monkeypatch):
    """Growing radii and split arrays give what all pairs give; with one radius each place would meet thousands."""
    rng = random.Random(8)
    to = [(k, f"s{k}", rng.gauss(23, 0.3), rng.gauss(49, 0.2)) for k in range(4000)] + [(4000 + k, f"t{k}", 23.0, 49.0) for k in range(50)]
    at = [(k, "p", rng.uniform(22, 24.5), rng.uniform(48.4, 49.6), "") for k in range(120)] + [(500, "p", 23.0, 49.0, ""), (501, "p", 40.0, 10.0, "")]
    places, points = spark.createDataFrame(at, PLACE), spark.createDataFrame(to, POINT)
    radii = spatial._radii(points, 60_000.0, 3)
    assert len(radii) > 1 and radii[0][0] < 10_000 and radii[-1][0] == 60_000.0
    want = set()
    for k, _, x, y, _ in at:
        near = sorted((metres(x, y, sx, sy), seq) for seq, _, sx, sy in to)
        want |= {(k, pos, seq) for pos, (d, seq) in enumerate(near[:3], 1) if d <= 60_000}
    for chunk in (spatial.CHUNK, 40):
        monkeypatch.setattr(spatial, "CHUNK", chunk)
        assert {(r["place_id"], r["pos"], r["seq"]) for r in spatial.nearest(places, points, 60_000.0, 3).collect()} == want


def test_blocks_of_lines_equal_all_pairs():
    rng = np.random.default_rng(3)
    x, y = rng.uniform(23, 23.1, 700), rng.uniform(49, 49.1, 700)
    ax, ay = rng.uniform(22.95, 23.1, 900), rng.uniform(48.95, 49.1, 900)
    bx, by = ax + rng.uniform(-0.05, 0.05, 900), ay + rng.uniform(-0.05, 0.05, 900)
    bx[:5], by[:5] = ax[:5], ay[:5]
    line = np.sort(rng.integers(0, 400, 900))
    scale = 111_320 * np.cos(np.radians(y))
    for radius in (120.0, 5_000.0):
        found, far = nearest_lines(x, y, scale, ax, ay, bx, by, line, radius)
        for k in range(len(x)):
            dx, dy = bx - ax, by - ay
            t = np.clip(((x[k] - ax) * dx + (y[k] - ay) * dy) / np.where(dx * dx + dy * dy > 0, dx * dx + dy * dy, 1), 0, 1)
            ex, ey = ax + t * dx - x[k], ay + t * dy - y[k]
            firsts = [min(np.flatnonzero(line == n), key=lambda s: (ex[s] ** 2 + ey[s] ** 2, s)) for n in np.unique(line)]
            m = np.hypot(ex * scale[k], ey * 110_574)
            best = min(firsts, key=lambda s: (m[s], s))
            assert (found[k] == best and abs(far[k] - m[best]) < 1e-6) if m[best] <= radius else found[k] == -1


def test_cells_beside_a_long_street_are_left_out(spark):
    line = "seq long, name string, line array<struct<lon: double, lat: double>>"
    streets = spark.createDataFrame([(1, "long", [(23.0, 49.0), (24.0, 50.0)]), (2, "bent", [(23.5, 49.2), (23.9, 49.2), (23.9, 49.21)])], line)
    at = spark.createDataFrame([(1, "p", 23.5, 49.5003, ""), (2, "p", 23.9, 49.2005, ""), (3, "p", 23.2, 49.8, "")], PLACE)
    assert {(r["place_id"], r["name"]) for r in spatial.nearest_street(at, streets).collect()} == {(1, "long"), (2, "bent")}


def test_shapes_keep_their_digits(spark, tmp_path):
    """49.12 lies on the hole's edge only after the corner is added and rounded: the SQL takes the corner off instead."""
    spark.createDataFrame([(6800, "c", "M"), (60, "d", "M")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name")).write.parquet(f"{tmp_path}/nation.parquet")
    assert [r["place_id"] for r in QUERIES["point_in_slanted_area"](spark, str(tmp_path)).collect()] == [60]


def test_a_centroid_is_found_once(spark, tmp_path):
    """The plan names the sum over a shape once; before, each column and filter summed it anew."""
    spark.createDataFrame([(k, f"c{k}", "M") for k in range(6)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["located_points"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(flatten(") == 1
    assert found.count() == 6
