"""Spelling variants against a plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from waymark.llm import variants

ALPHABET = "abcdeé"


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    forms = {}
    for w, found in near.items():
        best = min(((-words[v], v) for v in found), default=None)
        forms[w] = best[1] if best and -best[0] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(3)
    made = {"".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(5, 8))): rnd.choice((3, 3, 4, 7, 9, 20, 64, 200)) for _ in range(1500)}
    return made | {"aaaaa": 50, "aaaaaa": 50, "aaaaaaa": 3, "abababab": 5, "babababa": 9}


def grouped(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("bucket", [4096, 300, 7])
def test_equals_a_comparison_of_all_pairs(spark, words, bucket):
    """Also where groups are far larger than a bucket."""
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert grouped(variants.variants(df, bucket=bucket)) == brute(words)


def test_automata_are_minimal_and_number_their_words(words):
    for known in (sorted(words), sorted(w[::-1] for w in words), [], [""], ["", "a"]):
        automaton = variants.Automaton(known)
        for k, word in enumerate(known):
            state, number = automaton.walk(word)
            assert number == k and automaton.ends[state]
        assert automaton.walk("zz") is None
    # Words with one tail share its states: four first letters and one tail of three.
    shared = variants.Automaton(["aend", "bend", "cend", "dend"])
    reached, todo = set(), [0]
    while todo:
        state = todo.pop()
        if state not in reached:
            reached.add(state)
            todo += [t for t, _ in shared.arcs[state].values()]
    assert len(reached) == 5


def test_both_directions_are_needed_and_pairs_counted_once(spark):
    words = {"kitten": 9, "mitten": 3, "kittez": 4, "kittten": 3, "kiten": 3, "other": 3}
    got = {r["word"]: r for r in variants.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert got["kitten"]["n_near"] == 4 and got["mitten"]["n_near"] == 1 and got["kiten"]["n_near"] == 1
    assert got["mitten"]["form"] == "kitten" and got["kitten"]["form"] is None and got["other"]["n_near"] == 0


def test_documents_with_nulls_long_texts_and_repeats(spark):
    rnd = random.Random(9)
    base = ["garden", "gardens", "gardn", "Straße", "straÿe", "naïve", "NAÏVE", "x" * 3000, "tiny", "winter", "winder", "wínter"]
    docs = [(k, " ".join(rnd.choice(base) + rnd.choice((" ", "-", "7")) for _ in range(40))) for k in range(60)]
    docs += [(None, "garden winter " * 50), (None, None), (7, ""), (8, "12 -- ??"), (9, "winter " * 50_000), (9, docs[9][1]), (9, docs[9][1])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "run": F.lit(0), "h": F.lit(0)})
    want = brute_words(docs)
    assert {r["word"]: r["n"] for r in variants.words_of(df).collect()} == want and len(want) > 10
    assert grouped(variants.variants(variants.words_of(df))) == brute(want)


def test_without_words(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert variants.variants(variants.words_of(empty)).collect() == []


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert grouped(variants.op13_variants(spark, "/root/testdata/sf0.001")) == brute(brute_words([tuple(r) for r in rows]))
