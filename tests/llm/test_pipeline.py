"""The pipeline against brute force on a small table, and the registry."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
from waymark.llm import registry, simhash

WORDS = [a + b for a in ("ba", "de", "fi", "go", "hu", "ka", "lo", "mi", "nu", "pa") for b in ("ran", "lek", "sto", "vin", "dor", "mat")]


def sentence(seed, n):
    out = []
    for k in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append(WORDS[(seed >> 8) % len(WORDS)])
    return " ".join(out)


def test_stages_against_brute_force(spark, tmp_path):
    leak = sentence(999, 30)
    texts = {k: sentence(k + 1, 120) for k in range(30)}
    texts |= {40: texts[3], 41: texts[3], 42: None, 43: "123 456", 44: sentence(77, 60) + " " + leak, 45: sentence(78, 60) + " mail a.b@c.example +1 (716) 555-3986"}
    rows = [(k, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"] for r in docs.collect()})
    first = {k for k, t in texts.items() if t and re.search("[a-z]", t)}
    assert kept[0] == first
    prints = defaultdict(list)
    for k in sorted(first):
        prints[simhash.simhash(texts[k])].append(k)
    assert kept[1] == {own[0] for own in prints.values()}
    assert kept[2] == kept[1] - {44} == kept[3] == kept[4]
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out3")).collect()}
    assert text[45].endswith(" mail [EMAIL] [PHONE]") and text[3] == texts[3]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept[4]


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, redacted int, _row_key string, aside string, fp int"


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, one doc_id for several texts, and columns called like an operator's own."""
    leak, own = sentence(999, 30), [sentence(k + 50, 80) for k in range(9)]
    texts = [
        (1, own[0]), (1, own[0]), (1, own[1]), (2, own[1]), (None, own[2]), (None, own[2]), (None, own[3]), (3, own[3]), (None, own[4] + " " + leak), (None, own[5]),
        (4, None), (5, ""), (None, None), (6, "9" * 50_000), (7, sentence(7, 30_000)), (8, own[6] + " +1 (716) 555-3986"), (8, own[7] + " " + leak), (8, own[8]),
    ]
    rows = [(k, t, "en", None, None if t is None else len(t), "mine", 7, "key", "aside", 1) for k, t in texts]
    spark.createDataFrame(rows, ODD).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"odd{k}"))
        docs = spark.read.parquet(str(tmp_path / f"odd{k}"))
        kept.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) if k < 4 else None)
        if k < 4:
            assert docs.columns == [f.split()[0] for f in ODD.split(", ")]
            assert {(r["score"], r["redacted"], r["_row_key"], r["aside"], r["fp"]) for r in docs.collect()} == {("mine", 7, "key", "aside", 1)}
    worded = [(k, t) for k, t in texts if t and re.search("[a-z]", t)]
    assert kept[0] == sorted(worded, key=str)
    prints = defaultdict(list)
    for k, t in worded:
        prints[simhash.simhash(t)].append((k is None, k or 0, k, t))
    alone = [min(group, key=lambda x: x[:2])[2:] for group in prints.values()]
    assert kept[1] == sorted(alone, key=str)
    assert kept[2] == sorted([(k, t) for k, t in alone if leak not in t], key=str)
    assert kept[3] == sorted([(k, t.replace("+1 (716) 555-3986", "[PHONE]")) for k, t in alone if leak not in t], key=str)
    pieces = [r for r in docs.collect() if r["piece"] == 0]
    assert sorted(str(r["doc_id"]) for r in pieces) == sorted(str(k) for k, _ in kept[3])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
