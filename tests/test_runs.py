"""Postings as runs of sorted refs, and word sets from one batch kernel."""

from __future__ import annotations

import random
import re

import pyarrow as pa

from waymark.functions import text
from waymark.operators import codec, index
from waymark.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_go_on_over_batches_and_keep_repeats_and_nulls(spark):
    rnd = random.Random(2)
    rows = [(w, rnd.randrange(9000), rnd.random() < 0.5) for w in ("a", "b", "ß", "") for _ in range(40)] + [("a", None, True)] * 2 + [("z", None, False)]
    rows += rows[:3]
    pairs = spark.createDataFrame(rows, "word string, place_id bigint, named boolean").repartition(3)
    want = {}
    for w, p, named in rows:
        want.setdefault((w, None if p is None else (p * 2 + named) >> index.RANGE_BITS), []).append(None if p is None else p * 2 + named)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("1", "3", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            got = {(r["word"], r["range"]): (r["places"], r["postings"]) for r in index.postings(pairs).collect()}
            assert got == {k: (len(v), sorted(x for x in v if x is not None)) for k, v in want.items()}
            blocks = codec.encode(pairs)
            assert {(r["word"], r["range"]): r["postings"] for r in codec.decode(blocks).collect()} == {k: sorted(v) for k, v in want.items() if k[1] is not None}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" not in plan(index.postings(pairs))


def test_codec_passes_the_blocks_once(spark):
    assert "Join" not in plan(QUERIES["postings_codec"](spark, "/root/testdata/sf0.001"))


def test_words_need_neither_cleaning_nor_patterns_of_whole_texts(spark):
    found = plan(QUERIES["postings_bytes"](spark, "/root/testdata/sf0.001"))
    assert "covered_words" in found and "regexp_replace(text" not in found and "(?U)" not in found


def test_word_sets_of_parts_equal_those_of_whole_texts():
    rnd = random.Random(3)
    signs = "aBz09_ .,-\n\x1c'éÉßſıЖґйЇΣςά́’ €½İﬁẛ漢"
    texts = ["".join(rnd.choice(signs[: rnd.choice((12, 24, 32, 99))]) for _ in range(rnd.randrange(25))) for _ in range(4000)] + ["", None]
    got = text.covered_words.func(pa.array(texts)).to_pylist()
    covered = re.compile(text._is_covered().__self__.pattern)
    assert sum(x is not None for x in got) > 1000
    for t, words in zip(texts, got, strict=True):
        if t is not None and covered.match(t):
            assert words == sorted(set(re.findall(r"\w+", text.fold(t))))
        else:
            assert words is None
