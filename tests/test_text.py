"""Folding, tokenising, romanising and similarity."""

from __future__ import annotations

import difflib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import text as t
from waymark.functions.similarity import score_pairs


def column(spark, values, make):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["out"] for r in rows.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_folding_goldens(spark):
    given_ = ["Київ", "ЛЬВІВ", "Хмельницький", "ў", "ój", "ß", None]
    want = ["киів", "львів", "хмельницькии", "у", "oj", "ss", None]
    assert column(spark, given_, t.normalise) == want
    assert column(spark, given_, t.normalise_exact) == want


def test_native_folding_equals_the_exact_form(spark):
    letters = [chr(c) for c in (*range(0x20, 0x180), *range(0x400, 0x530)) if unicodedata.category(chr(c))[0] in "LNPZ"]
    letters = [c for c in letters if c.isalpha() or len(t.fold(c)) == 1]
    assert column(spark, letters, t.normalise) == [t.fold(c) for c in letters]


def test_folding_any_script(spark):
    given_ = ["Ἀθήνα", "ﬁn ½", "ＡＢＣ", "ԵՐԵՎԱՆ և", "한국 값", "STRASSE Straße", "ⅷ ㎏", "שָׁלוֹם", "Ünïcödé", "plain ASCII", "", None]
    assert column(spark, given_, t.normalise) == [None if v is None else t.fold(v) for v in given_]
    assert column(spark, ["Ἀθήνα"], t.normalise) == ["αθηνα"]
    every = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000] + ["a" + chr(c) for c in range(0x1D400, 0x1D500)]
    assert column(spark, every, t.normalise) == [t.fold(c) for c in every]


def test_case_folding(spark):
    given_ = ["Straße", "STRASSE", "ΟΔΟΣ", "οδος", "ŉ", "İstanbul", "Київ", "ﬀ", None]
    assert column(spark, given_, t.casefold) == [None if v is None else v.casefold() for v in given_]


def test_clean_takes_every_white_space(spark):
    assert column(spark, ["a\x1c\x1fb \u2003c\x85", None], t.clean) == ["a b c", ""]


def test_words(spark):
    assert column(spark, ["Медовий двір!", "a_1 b-2", "", None], lambda v: t.words(t.normalise(v))) == [["медовии", "двір"], ["a_1", "b", "2"], [], None]


def test_romanising(spark):
    assert column(spark, ["Київ", "згода", "Г", "м'яч", "Юля є"], t.romanise_kmu) == ["kyiv", "zghoda", "h", "myach", "yulia ye"]
    assert column(spark, ["Г", "щука", "їжак"], t.romanise_naive) == ["g", "schuka", "izhak"]
    rows = column(spark, ["Г", "abc", "дата", None], t.romanisations)
    assert [[(r["scheme"], r["value"]) for r in x] if x is not None else [] for x in rows] == [
        [("translit_kmu", "h"), ("translit_naive", "g")], [], [("translit_kmu", "data")], []
    ]


@pytest.mark.parametrize(("a", "b", "ratio"), [("двир", "двір", 0.75), ("медовы", "медовии", 0.769), ("славское", "славсько", 0.875)])
def test_ratio_goldens(spark, a, b, ratio):
    row = score_pairs(spark.createDataFrame([(a, b)], "word string, candidate string")).first()
    assert row["score"] == pytest.approx(ratio, abs=1e-3)


def test_similarity_gates(spark):
    pairs = [("ab", "abc"), ("bc", "abcd"), ("a", "bcdefgh"), ("abcd", "abxd")]
    got = {(r["word"], r["candidate"]): r["score"] for r in score_pairs(spark.createDataFrame(pairs, "word string, candidate string")).collect()}
    assert got == {("ab", "abc"): 1.0, ("bc", "abcd"): 0.9, ("a", "bcdefgh"): 0.0, ("abcd", "abxd"): difflib.SequenceMatcher(None, "abcd", "abxd").ratio()}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_fold_is_idempotent_for_plain_text(value):
    folded = t.fold(value)
    assert not any(unicodedata.combining(c) for c in folded)
