"""Hard negatives against a plain reading of the contract."""

from __future__ import annotations

import math

import numpy as np
import pytest

from waymark.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, step=100, k=10):
    """Every anchor's hits by sorting all rows in Python."""
    sound = [(i, [math.floor(256 * float(x)) for x in v], n) for i, v, n in rows if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = sorted({(i, tuple(v), n) for i, v, n in sound if i is not None and i % step == 0})
    out = []
    for a, own, label in anchors:
        scored = [(-sum(x * y for x, y in zip(own, v, strict=True)), i is None, i, n) for i, v, n in sound if i != a and len(v) == len(own)]
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for p in [r for r in scored if r[3] == label][:5]:
            near = [r for r in scored if r[3] != label and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0]][:k]
            out += [(a, p[2], rank, r[2], -p[0], -r[0]) for rank, r in enumerate(near, 1)]
    return out


def mined(df, **more):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(map(tuple, negatives.mine(df, **more).collect()), key=key)


def listed(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def rows():
    made = np.random.default_rng(5)
    vectors = made.normal(0, 0.2, (400, 8)).astype(np.float32)
    vectors[50:120] = vectors[50]  # ties by the dozen
    return [(int(i), [float(x) for x in v], int(made.integers(0, 4))) for i, v in zip(made.permutation(1000)[:400] * 5, vectors, strict=True)]


def test_equals_brute_force(spark, rows):
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == listed(brute(rows))


def test_blocks_of_anchors_and_rows_change_nothing(spark, rows, monkeypatch):
    want = listed(brute(rows, step=25))
    assert mined(spark.createDataFrame(rows, SCHEMA), step=25, at_once=3) == want
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    order = np.lexsort((labels, ids))
    vectors = np.floor(256 * np.array([r[1] for r in rows], dtype=float))[order].astype(np.int64)
    scores, places = negatives.sorted_scores(vectors[:3], vectors)
    plain = vectors[:3] @ vectors.T
    for at in range(3):
        assert list(places[at]) == list(np.lexsort((np.arange(len(ids)), -plain[at])))
        assert list(scores[at]) == sorted(plain[at], reverse=True)


def test_large_numbers_are_exact():
    vectors = np.array([[2**30 + 1, 3], [2**30, 5], [-(2**62), 2**62]], dtype=np.int64)
    scores, places = negatives.sorted_scores(vectors[:1], vectors)
    assert places[0].tolist() == [0, 1, 2]
    assert scores[0].tolist() == [(2**30 + 1) ** 2 + 9, (2**30 + 1) * 2**30 + 15, -(2**63 - 1)]


def test_nulls_ties_repeats_and_odd_vectors(spark, rows):
    odd = [
        (None, rows[0][1], 1), (None, rows[60][1], 2), (100, None, 1), (200, rows[1][1], None), (300, [0.1, None] + [0.0] * 6, 1), (400, [float("nan")] + [0.1] * 7, 2),
        (500, [float("inf")] + [0.1] * 7, 2), (600, [0.5, 0.5], 1), (601, [0.4, 0.5], 1), (602, [0.3, 0.4], 2), (700, [], 1), (701, [], 2), (702, [], 1),
    ]
    many = rows + odd + rows[40:60] + [r for r in rows if r[0] % 100 == 0][:2]
    df = spark.createDataFrame(many, SCHEMA)
    assert mined(df) == listed(brute(many))
    # Columns of the caller's that are called like the operator's own do no harm.
    from pyspark.sql import functions as F

    clashing = df.select("*", F.lit("x").alias("score"), F.lit("y").alias("key"), F.lit(0).alias("rank"), F.lit(None).alias("vector"))
    assert mined(clashing) == listed(brute(many))


def test_without_rows_or_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [0.5], 1), (2, [0.5], 2)], SCHEMA)) == []  # no positive


def test_query_equals_its_sql(spark):
    import duckdb

    found = sorted(map(tuple, negatives.op12_negatives(spark, "/root/testdata/sf0.01").collect()))
    c = duckdb.connect()
    c.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    assert found == sorted(c.execute(negatives.SQL).fetchall()) and len(found) > 100
