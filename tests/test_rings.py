"""Rings from loose stretches: junctions, nesting, loose ends, size."""

from __future__ import annotations

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.functions.rings import polygons, rings
from waymark.sources import osm

box = lambda x, y, w, h=None: [(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w)), (x, y)]
of = lambda *lines: [np.array(line, dtype=float) for line in lines]


def area(ring):
    x, y = ring.real, ring.imag
    return abs(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) / 2


def sizes(*lines):
    return [[area(r) for r in poly] for poly in polygons(of(*lines))]


def cut(ring, at, seed):
    """A ring as stretches between some of its points, shuffled and partly turned round."""
    spots = sorted(at)
    whole = ring[:-1]
    parts = [[whole[k % len(whole)] for k in range(a, b + 1)] for a, b in zip(spots, [*spots[1:], spots[0] + len(whole)], strict=True)]
    dice = random.Random(seed)
    dice.shuffle(parts)
    return [p[::-1] if dice.random() < 0.5 else p for p in parts]


def test_stretches_in_any_order_and_direction():
    assert sizes(*cut(box(0, 0, 4), [0, 1, 3], 1)) == [[16]]
    assert sizes() == [] == sizes([(0, 0), (1, 0)]) == sizes([(0, 0)]) == sizes([(0, 0), (1, 0), (0, 0)])


def test_touching_rings_stay_apart():
    # Four stretches meet at (2, 2): the first that fits would run from one square into the other.
    lines = [[(2, 2), (0, 2), (0, 0)], [(2, 2), (4, 2), (4, 4)], [(0, 0), (2, 0), (2, 2)], [(4, 4), (2, 4), (2, 2)]]
    for _ in range(4):
        lines = lines[1:] + lines[:1]
        assert sizes(*lines) == [[4], [4]]


def test_figure_eight_is_two_rings():
    eight = [(0, 0), (2, 2), (4, 4), (4, 0), (2, 2), (0, 4), (0, 0)]
    assert sizes(eight) == [[4], [4]]
    assert all(len(set(r.tolist())) == len(r) - 1 for r in rings(of(eight)))


def test_hole_that_touches_and_hole_that_shares_an_edge():
    assert sizes(box(0, 0, 4), [(0, 0), (2, 1), (1, 2), (0, 0)]) == [[16, 1.5]]
    outer = [(0, 0), (1, 0), (3, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert sizes(outer, [(1, 0), (3, 0), (3, 2), (1, 2), (1, 0)]) == [[12]]  # the shared edge cancels: a notch
    assert sizes([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(2, 0), (4, 0), (4, 2), (2, 2), (2, 0)]) == [[8]]  # neighbours grow together


def test_island_in_a_lake_on_an_island():
    assert sizes(box(4, 4, 2), box(0, 0, 10), box(2, 2, 6), box(4.5, 4.5, 1), box(20, 0, 1)) == [[100, 36], [4, 1], [1]]


def test_loose_ends_are_left_out():
    assert sizes(*cut(box(0, 0, 4), [0, 2], 3), [(4, 4), (7, 7), (9, 9)], [(9, 9), (9, 10)], box(5, 0, 1)[:-1]) == [[16]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 40), st.integers(1, 6))
def test_any_star_is_found_whole(seed, corners, stretches):
    dice = random.Random(seed)
    turns = sorted(dice.uniform(0, 6.28) for _ in range(corners))
    ring = [(r * np.cos(t), r * np.sin(t)) for t in turns for r in [dice.uniform(1, 2)]]
    ring = [*ring, ring[0]]
    got = sizes(*cut(ring, dice.sample(range(corners), min(stretches, corners)), seed))
    assert np.allclose(got, [[area(np.array([complex(*p) for p in ring]))]])


def test_many_members_take_seconds():
    turns = np.linspace(0, 2 * np.pi, 200_000, endpoint=False)
    ring = [*zip(np.cos(turns) * 1000, np.sin(turns) * 1000, strict=True)]
    lines = cut([*ring, ring[0]], range(0, 200_000, 8), 5)
    lakes = [box(x * 4 - 600, y * 4 - 300, 2) for x in range(250) for y in range(100)]
    start = time.time()
    got = polygons(of(*lines, *lakes))
    assert len(got) == 1 and len(got[0]) == 25_001 and len(lines) + len(lakes) == 50_000
    assert time.time() - start < 30


def test_roles_do_not_decide(spark):
    nodes = spark.createDataFrame([(k, float(x), float(y), []) for k, (x, y) in enumerate(box(0, 0, 10)[:4] + box(2, 2, 6)[:4] + box(4, 4, 2)[:4])], "id bigint, lon double, lat double, tags array<struct<k: string, v: string>>")
    ways = spark.createDataFrame([(w, [4 * w + k for k in (0, 1, 2, 3, 0)], []) for w in range(3)] + [(9, [0, 99], [])], "id bigint, refs array<bigint>, tags array<struct<k: string, v: string>>")
    members = [("way", 2, "inner"), ("way", 0, ""), ("way", 1, "outer"), ("way", 0, "outer"), ("way", 9, "outer"), ("way", 77, "outer"), ("node", 0, "label")]
    relations = spark.createDataFrame([(5, members, [("type", "multipolygon")])], "id bigint, members array<struct<type: string, ref: bigint, role: string>>, tags array<struct<k: string, v: string>>")
    (row,) = osm.areas(relations, osm.lines(ways, nodes)).collect()
    assert [[len(r) for r in poly] for poly in row["polys"]] == [[5, 5], [5]]
