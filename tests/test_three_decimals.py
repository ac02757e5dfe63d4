"""Scores are shown as C's printf shows them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from waymark.functions.present import three_decimals


def test_three_decimals_round_as_printf(spark):
    rng = random.Random(2)
    values = {2 * m / s - p for s in range(2, 60) for m in range(1, s // 2 + 1) for p in (0.0, 0.01) if 2 * m / s >= 0.6}
    values |= {0.0, 1.0, 0.8125, 0.9275, 0.6775, 0.0005, 0.0015, 0.9995, 0.99951} | {rng.random() for _ in range(2000)} | {k / 2000 for k in range(2001)}
    values = {v for v in values if v == 0 or v >= 1 / 64}
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v double").select("v", three_decimals(F.col("v")).alias("t"))
    assert [r for r in df.collect() if r["t"] != "%.3f" % r["v"]] == []
