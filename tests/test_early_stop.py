"""A search that leaves out ranges of places finds what a full one finds, and reads less."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import index, search
from waymark.schema import QUERY, SearchParams

COMMON, MIDDLE = ["upper", "lower", "forest", "castle"], ["river", "garden", "meadow", "harbour", "station", "winter", "summer"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """3000 places: common words everywhere, middling ones in stretches of places, rare ones in one place or two."""
    dice = random.Random(4)
    rows = []
    for k in range(3000):
        own = [dice.choice(COMMON), f"rare{k // 2:04d}x"] + ([MIDDLE[k // 430]] if dice.random() < 0.3 else [])
        rows.append((k, " ".join(own), " ".join(dice.sample(COMMON, 2) + [dice.choice(MIDDLE)] * (k % 50 == 0)), "place=x", float(k % 90), float(k % 45)))
    folder = str(tmp_path_factory.mktemp("early"))
    index.write_index(index.terms(spark.createDataFrame(rows, "place_id long, name string, context string, category string, lon double, lat double")), folder)
    return index.Index.open(spark, folder)


def asked(spark):
    dice, texts = random.Random(9), ["upper lower", "castle", "garden harbour", "nothing", "", "upper upper", "rare01 castle", "forst castle"]
    for _ in range(25):
        rare = f"rare{dice.randrange(1500):04d}x"
        texts.append(" ".join(dice.sample([dice.choice(COMMON), dice.choice(MIDDLE), rare, rare[:-2] + "q" + rare[-1]], dice.randint(1, 3))))
    return spark.createDataFrame([(k, t, dice.choice([1, 3, 20]), dice.choice([0.6, 0.6, 0.9]), 10.0 if k % 2 else None, 10.0 if k % 2 else None) for k, t in enumerate(texts)], QUERY)


@pytest.mark.parametrize("params", [SearchParams(), SearchParams(max_incomplete=5, exact_topk=True)])
def test_hits_are_the_same(spark, stored, params):
    queries = asked(spark)
    shown = lambda early: sorted(map(str, search.search(stored, queries, params, early).collect()))
    full = shown(False)
    assert len(full) > 50 and shown(True) == full


def test_far_fewer_postings_are_read(spark, stored):
    queries = asked(spark)
    params = SearchParams()
    words, kinds = search.judged_places(stored, queries, params)
    resolved = search.resolve(words, stored, params)
    ranges = search.reach(words, resolved, queries, stored, params)
    first = search.tally(words, resolved, stored.pairs, params, ranges.where("whole"))
    every = search.tally(words, resolved, stored.pairs, params)
    # All ranked places lie in whole ranges, all others that count in listed ones.
    placed = kinds.withColumn("range", index.bound_range(F.col("place_id"))).join(ranges, ["query_id", "range"], "left")
    assert placed.where("whole is null or (kind = 'ranked' and not whole)").count() == 0
    assert placed.where(search.total("scores") > F.col("most")).count() == 0
    rest = search.still_open(ranges, kinds, queries, params)
    assert first.count() + search.tally(words, resolved, stored.pairs, params, rest).count() < every.count()
    assert first.count() * 2 < every.count()


def test_bounds_count_every_posting(stored):
    assert stored.bounds.agg(F.sum("refs")).first()[0] == stored.pairs.count()
    assert stored.bounds.count() * 2 < stored.pairs.count()
