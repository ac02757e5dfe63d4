"""Samples that hold at any size, and short benchmark items against a plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import decontaminate, langid
from waymark.llm._common import sampled


def test_shares_below_a_millionth_still_give_rows(spark):
    rows = spark.range(6_000_000, numPartitions=4)
    for most in (1, 2, 5):
        assert sampled(rows, most).count() == most  # shares of 3e-7 to 2e-6


def test_repeats_and_nulls_do_not_fill_the_sample(spark):
    hot = spark.range(100_000).select(F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(3000).select(F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 > 0, "fr").otherwise("en").alias("lang"))
    nulls = spark.range(50_000).select(F.lit(None).cast("string").alias("text"), F.lit("fr").alias("lang"))
    rows = hot.unionByName(rest).unionByName(nulls)
    got = sampled(rows, 200, "lang")
    assert got.groupBy("lang").count().collect() and {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()} == {"en": 200, "fr": 200}
    assert got.distinct().count() == 400
    again = sampled(rows.repartition(7), 200, "lang")
    assert sorted(map(tuple, again.fillna("-").collect())) == sorted(map(tuple, got.fillna("-").collect()))
    assert sampled(rows.limit(0), 5).collect() == [] and sampled(rows.limit(0), 5, "lang").collect() == []


def test_languages_are_learned_where_ids_are_missing_and_rows_repeat(spark):
    rnd = random.Random(2)
    words = {"en": ["the", "house", "with", "garden", "and", "weather"], "fr": ["une", "maison", "avec", "jardin", "et", "beaucoup"]}
    rows = [(None if k % 3 == 0 else k, " ".join(rnd.choice(words[lang]) for _ in range(30)), lang) for k in range(400) for lang in words]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    hot = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the house with garden").alias("text"), F.lit("en").alias("lang"))
    model = langid.train(docs.unionByName(hot), sample=50)
    judged = langid.identify(docs, model)
    assert judged.where("lang_pred = lang").count() >= 0.97 * len(rows)


def plain(docs, items):
    """(doc, item, brief): items under ten words that stand in a document, with one other word from five words on."""
    out = set()
    for d, body in docs:
        for i, item in items:
            n = len(item)
            for at in range(len(body) - n + 1):
                same = sum(a == b for a, b in zip(body[at : at + n], item, strict=True))
                if same >= n - (n >= 5):
                    out.add((d, i, n < 4 and len(body) > n))
    return out


def test_short_items_equal_a_plain_search(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(n * 10 + k, [rnd.choice(vocabulary) for _ in range(n)]) for n in range(1, 10) for k in range(4)]
    docs = []
    for k in range(150):
        item = list(rnd.choice(items)[1])
        if k % 2 and len(item) > 1:
            item[rnd.randrange(len(item))] = "other"
        docs.append((k, ([] if k % 10 == 0 else [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]) + item + [rnd.choice(vocabulary) for _ in range(0 if k % 5 == 0 else 20)]))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id bigint, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    got = decontaminate.overlaps(d, b).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    want = plain(docs, items)
    assert found == {(x, y) for x, y, _ in want}
    # A pair may have brief and whole runs only for documents that are the item itself.
    assert {(r["doc_id"], r["item_id"], r["brief"]) for r in got} == want


@pytest.mark.parametrize("size", range(2, 13))
@pytest.mark.parametrize("changed", [0, 1])
def test_recall_by_length_of_item(spark, size, changed):
    rnd = random.Random(size)
    items = [(k, [f"w{rnd.randrange(3000)}" for _ in range(size)]) for k in range(60)]
    docs = []
    for k, item in items:
        own = list(item)
        for at in rnd.sample(range(size), changed):
            own[at] = "zz"
        docs.append((k, " ".join([f"v{rnd.randrange(3000)}" for _ in range(30)] + own + [f"v{rnd.randrange(3000)}" for _ in range(30)])))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, b).collect()}
    recall = len(got) / len(items)
    print(f"words {size} changed {changed} recall {recall:.2f}")
    assert not {p for p in got if p[0] != p[1]}
    assert recall == 1 if not changed or size >= 5 else recall == 0
