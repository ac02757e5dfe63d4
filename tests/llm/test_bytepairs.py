"""Byte-level BPE against the tokenizer's own library and a plain reading of the merges."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from waymark.llm import bytepairs


@pytest.fixture(scope="module")
def ranks():
    return bytepairs.read_ranks(public_tokenizers.path(bytepairs.RANKS))


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged(word: bytes, ranks) -> list[int]:
    """Leftmost pair of the lowest rank first, one at a time."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[k : k + 1] for k in range(len(word))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


TEXTS = [
    "", None, " ", "\n\n  x\t\t y  ", "It's we'll THEY'RE 'tis don''t", "naïve Straße Київ 東京都 שלום 🙂👩‍👩‍👧 é", "a b c　 d\u0085e​f",
    "<|endoftext|> 12345678901234567890 ٣٤٥ Ⅷ ½", "\U0001e4d0\U00010d4a ࡰab \U0001ccf0", "x" * 30_000, "ab" * 3001 + "aab" * 501, "\x00\x01\x7f", "_-=+" * 300, "loremipsumdolor" * 400 + " " * 5000,
]


def test_texts_of_all_kinds(spark, ranks, theirs):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("abcdeéßЖ漢 \n'1.") for _ in range(rnd.randint(1, 400))) for _ in range(60)] + ["same words again"] * 5
    docs = spark.createDataFrame([(k if k % 7 else None, t, "i") for k, t in enumerate(texts)], "doc_id bigint, text string, ids string").withColumns({"word": F.lit(1), "block": F.lit("b"), "row": F.lit(2)})
    for remembered in (1 << 20, 5):
        got = bytepairs.decode(bytepairs.encode(docs, ranks, public_tokenizers.PATTERN, remembered=remembered), ranks).withColumn("text", F.col("decoded").cast("string"))
        assert sorted(got.columns) == sorted([*docs.columns, "decoded"])
        found = sorted((r["text"] or "", list(r["ids"]), bytes(r["decoded"])) for r in got.collect())
        assert found == sorted((t or "", theirs.encode_ordinary(t or ""), (t or "").encode()) for t in texts)


def test_slices_hold_whole_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[1] * n for n in (3, 0, 50, 2, 2, 2, 9, 0)])], names=["x"])
    for most in (1, 4, 10, 1000):
        parts = list(bytepairs._slices(batch, 0, most))
        assert [row for p in parts for row in p.column(0).to_pylist()] == batch.column(0).to_pylist()
        assert all(len(p) == 1 or sum(map(len, p.column(0).to_pylist())) <= most for p in parts)


def test_folds_of_short_and_long_words_equal_single_merges(spark, monkeypatch):
    """Also where a merged part forms a lower rank with its neighbour, so that merging all pairs at once would differ."""
    base = {bytes([b]): b for b in range(256)}
    ranks = base | {w.encode(): 256 + k for k, w in enumerate(["aba", "bcb", "ab", "bc", "cab", "aa", "abab", "bcbc", "aaaa", "ca", "bca", "abc"])}
    assert b"ab" in bytepairs.uneasy(ranks) and b"abab" not in bytepairs.uneasy(ranks)
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90))) for _ in range(250)} | {"ab" * 60, "a" * 75, "abc" * 40})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {w: merged(w.encode(), ranks) for w in words}
    for short in (bytepairs.SHORT, 0, 1000):
        monkeypatch.setattr(bytepairs, "SHORT", short)
        assert {r["word"]: list(r["ids"]) for r in bytepairs.encode_words(df, ranks).collect()} == want


def test_pattern_knows_the_librarys_letters_digits_and_spaces(spark):
    own = bytepairs.spark_pattern(spark, r"[^\s\p{L}\p{N}]")
    points = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    ours = {r["id"] for r in points.where(F.col("c").rlike(own)).select("id").collect()}
    probe = tiktoken.Encoding("probe", pat_str=r"[^\s\p{L}\p{N}]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert ours | {0xFEFF} == set(map(ord, probe.decode(probe.encode_ordinary(every))))  # decoding takes that one for a byte order mark
    inside = bytepairs.spark_pattern(spark, r" ?\p{L}+")
    letter = {r["id"] for r in points.where(F.col("c").rlike(inside)).select("id").collect()}
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    assert letter == set(map(ord, probe.decode(probe.encode_ordinary(every))))


def test_decoding_stands_alone(spark, ranks, theirs):
    df = spark.createDataFrame([(theirs.encode_ordinary(t),) for t in ("Größe 東京", "")], "ids array<int>")
    assert [bytes(r["decoded"]).decode() for r in bytepairs.decode(df, ranks).collect()] == ["Größe 東京", ""]


def test_empty_table(spark, ranks):
    assert bytepairs.encode(spark.createDataFrame([], "doc_id bigint, text string"), ranks, public_tokenizers.PATTERN).collect() == []


def test_query_equals_the_library(spark, theirs):
    got = {r["doc_id"]: tuple(r)[1:] for r in bytepairs.op11_bytepairs(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = theirs.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert got == want


def test_remembered_words_are_not_hashed_for_each_slice(monkeypatch):
    """The hash tables that look-ups build have the common words and those of the batch, never all remembered ones."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rnd = random.Random(3)
    known = pa.array([f"w{k}" for k in range(5000)])
    words = [[f"w{min(rnd.randrange(6000), rnd.randrange(6000), rnd.randrange(6000))}" for _ in range(n)] for n in (0, 40, 3, 0, 200, 1, 90, 0, 70, 300)]
    batch, common = pa.RecordBatch.from_arrays([pa.array(words)], names=["words"]), pa.array(np.arange(0, 50, dtype=np.int32)[::-1])
    sizes, own = [], pc.index_in
    monkeypatch.setattr(pc, "index_in", lambda values, value_set: sizes.append(len(value_set)) or own(values, value_set=value_set))
    monkeypatch.setattr(bytepairs, "_slices", lambda batch, column: (batch.slice(k, 2) for k in range(0, len(batch), 2)))
    for together in (1, 3, 8):
        monkeypatch.setattr(bytepairs, "TOGETHER", together)
        got = [(part.column(0).to_pylist(), at.to_pylist()) for part, at in bytepairs._looked_up(batch, 0, known, common)]
        assert [row for rows, _ in got for row in rows] == words
        assert [k for _, at in got for k in at] == [int(w[1:]) if int(w[1:]) < len(known) else None for row in words for w in row]
    assert max(sizes) <= sum(map(len, words))
    assert [(len(p), len(at)) for p, at in bytepairs._looked_up(batch, 0, known.slice(0, 0), common.slice(0, 0))] == [(2, len(words[k]) + len(words[k + 1])) for k in range(0, 10, 2)]


def test_short_words_merge_over_numbers(spark, ranks, theirs):
    """Up to the longest word that the fold over numbers takes, and beyond; its state holds no strings or structs, which lambdas would copy."""
    rnd = random.Random(12)
    words = sorted({"".join(rnd.choice("abeinrst üß漢") for _ in range(n)) for n in range(1, 70) for _ in range(4)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r["word"]: list(r["ids"]) for r in bytepairs.encode_words(df, ranks).collect()} == {w: merged(w.encode(), ranks) for w in words}
    held = bytepairs.rank_map(ranks)
    fold = df.select(bytepairs.bound(held, lambda h: bytepairs.Merges(h)._short(F.hex("word"))).alias("ids"), F.length(F.hex("word")).alias("n"), "word").where(F.col("n") <= 2 * bytepairs.MOST)
    assert {r["word"]: list(r["ids"]) for r in fold.collect()} == {w: merged(w.encode(), ranks) for w in words if len(w.encode()) <= bytepairs.MOST}
