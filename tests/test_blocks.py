"""The block kernel against the standard library's matcher, and the bound that spares ratios."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from waymark.functions import blocks
from waymark.functions.similarity import block_ratio, ratio_bound, score_pairs
from waymark.schema import SearchParams


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def pairs(n=1500, signs="абвгд", longest=14):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(signs) for _ in range(rnd.randint(0, longest)))
    return [(word(), word()) for _ in range(n)] + [("", ""), ("a", ""), ("двир", "двір"), ("медовы", "медовии"), ("a" * 500, "b" + "a" * 400), ("🙂ab", "ab🙂")]


def test_ratios_equal_the_matcher(monkeypatch):
    for signs in ("ab", "абвгд", "abcdefghij"):
        own = pairs(signs=signs)
        got = blocks.ratios(*map(list, zip(*own, strict=True)))
        assert [round(x, 12) for x in got] == [round(plain(a, b), 12) for a, b in own]
    assert len(blocks.ratios([], [])) == 0
    monkeypatch.setattr(blocks, "CELLS", 64)
    own = pairs(200)
    assert [round(x, 12) for x in blocks.ratios(*map(list, zip(*own, strict=True)))] == [round(plain(a, b), 12) for a, b in own]


def test_nulls_bounds_and_the_share_sent_to_python(spark):
    own = sorted({p for p in pairs(600, "abcdef", 9) if all(p)})
    df = spark.createDataFrame([*own, (None, "a"), ("a", None)], "word string, candidate string").repartition(3)
    rows = df.select("word", "candidate", block_ratio("word", "candidate").alias("r"), ratio_bound(F.col("word"), F.col("candidate")).alias("most")).collect()
    for r in rows:
        if r["word"] is None or r["candidate"] is None:
            assert r["r"] is None
        else:
            assert abs(r["r"] - plain(r["word"], r["candidate"])) < 1e-12 and r["most"] >= r["r"] - 1e-12
    whole = {(r["word"], r["candidate"]): r["score"] for r in score_pairs(df.na.drop()).collect()}
    spared = {(r["word"], r["candidate"]): r["score"] for r in score_pairs(df.na.drop(), least=F.lit(0.6)).collect()}
    assert {k: v for k, v in whole.items() if v >= 0.6} == {k: v for k, v in spared.items() if v >= 0.6}
    gap = SearchParams().max_length_gap
    need = [(a, b) for a, b in own if a not in b and abs(len(a) - len(b)) <= gap]
    sent = df.na.drop().where(ratio_bound(F.col("word"), F.col("candidate")) >= 0.6).collect()
    assert len([1 for r in sent if (r["word"], r["candidate"]) in set(need)]) < 0.6 * len(need)
