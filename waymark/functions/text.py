"""Cleaning, folding, tokenising and romanising text, as Spark expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1C-\x1F]+", " "))


def fold(text: str) -> str:
    """Case folding and compatibility decomposition without combining marks, for one Python string."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


#: Code points that the expressions below fold by themselves: Latin, Greek, Cyrillic and general punctuation.
_OWN = (*range(0x530), *range(0x1E00, 0x1F00), *range(0x2010, 0x2070), *range(0x20A0, 0x20C1))
_ASCII = r"^\p{ASCII}*+$"


def _covered(known: list[int]) -> str:
    """A pattern of the texts that hold only ``known`` code points."""
    runs: list[list[int]] = []
    for code in sorted(known):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "^[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]*+$"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str]:
    """What :func:`fold` does to each of these characters (source, target; deleted ones last), and the texts it covers."""
    one, gone, known = {}, [], [ord("ß")]
    for char in map(chr, _OWN):
        to = fold(char)
        if to == char or len(to) <= 1:
            known.append(ord(char))
        if to != char and len(to) == 1:
            one[char] = to
        elif not to:
            gone.append(char)
    return "".join(one) + "".join(gone), "".join(one.values()), _covered(known)


@F.pandas_udf(T.StringType())
def normalise_exact(text: pd.Series) -> pd.Series:
    """:func:`fold` for any script."""
    return text.map(lambda t: None if t is None else fold(t))


def normalise(text: Column) -> Column:
    """:func:`fold`, inside the JVM for the scripts of ``_OWN``; only texts with other characters are sent to Python."""
    source, target, covered = _fold_tables()
    here = F.when(text.rlike(_ASCII), F.lower(text)).when(text.rlike(covered), F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), source, target))
    return F.coalesce(here, normalise_exact(F.when(~text.rlike(covered), text)))


@lru_cache(maxsize=1)
def _plain_case() -> str:
    """The texts that lower-casing folds, but for the two letters that :func:`casefold` handles."""
    return _covered([ord(c) for c in map(chr, range(0x530)) if c in "ßς" or (c.casefold() == c.lower() and len(c.lower()) == 1)])


@F.pandas_udf(T.StringType())
def casefold_exact(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def casefold(text: Column) -> Column:
    """Case folding: what lower-casing does, and letters such as ß beyond it."""
    here = F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    return F.coalesce(F.when(text.rlike(_plain_case()), here), casefold_exact(F.when(~text.rlike(_plain_case()), text)))


def words(text: Column) -> Column:
    """All words of a text in turn: runs of letters, numbers and underscores."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


@lru_cache(maxsize=1)
def _is_covered():
    """Whether a text holds only what ``_OWN`` covers; for these the word signs of Python and Spark are the same."""
    return re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _fold_tables()[2]).replace("$", r"\Z")).match


#: What ASCII folds to: small letters, digits, underscores and spaces; bytes of other signs stay.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in bytes(range(256)).lower())


@F.arrow_udf(T.ArrayType(T.StringType()))
def covered_words(text: pa.Array) -> pa.Array:
    """The sorted word set of each folded text; null for texts in other scripts.

    Folding goes sign by sign, so a text may be cut at its ASCII separators first; of what lies between, only the distinct
    parts with other signs are folded and cut by themselves.
    """
    known, found, seen, flat, ends = _is_covered(), re.compile(r"\w+").findall, {}, [], [0]
    for value in text.cast(pa.binary()):
        parts = None if (t := value.as_py()) is None else set(t.translate(_PLAIN).split())
        if parts and not t.isascii():
            own = [p for p in parts if not p.isascii()]
            for p in own:
                if p not in seen:
                    seen[p] = [w.encode() for w in found(fold(s))] if known(s := p.decode()) else None
            parts = None if any(seen[p] is None for p in own) else parts.difference(own).union(*(seen[p] for p in own))
        if parts is None:
            ends[-1:] = [None, len(flat)]
            continue
        flat += sorted(parts)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))


def with_word_sets(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``df`` with the sorted sets of the folded words of text columns; ``texts``: set by text; null texts have empty sets.

    One batch kernel for the scripts of ``_OWN``; Spark's expressions for the other texts only, so that all words are cut alike.
    """
    found = df.withColumns({made: covered_words(F.col(text)) for made, text in texts.items()})
    other = {made: F.when(F.col(made).isNull(), F.col(text)) for made, text in texts.items()}
    rest = found.withColumns({f"_other{made}": text for made, text in other.items()})
    sets = {made: F.coalesce(made, F.sort_array(word_set(normalise(F.col(f"_other{made}")))), F.array().cast("array<string>")) for made in texts}
    return rest.withColumns(sets).drop(*(f"_other{made}" for made in texts))


def is_cyrillic(text: Column) -> Column:
    return text.rlike(r"[Ѐ-ӿ]")


# The official Ukrainian romanisation, with Russian letters that occur beside it.
SINGLE = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "з": "z", "и": "y", "і": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "ы": "y", "э": "e", "ё": "e",
}
SEVERAL = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch"}
DELETED = "ь'’ʼъ"
POSITIONAL = {"є": ("ye", "ie"), "ї": ("yi", "i"), "й": ("y", "i"), "ю": ("yu", "iu"), "я": ("ya", "ia")}
# How the same letters are usually typed.
TYPED_SINGLE = {"г": "g", "и": "i", "х": "h", "ц": "c", "ї": "i", "й": "y"}
TYPED_SEVERAL = {"щ": "sch", "є": "ye", "ю": "yu", "я": "ya"}


def _spell(text: Column, single: dict[str, str], several: dict[str, str]) -> Column:
    for letter, to in several.items():
        text = F.replace(text, F.lit(letter), F.lit(to))
    return F.translate(text, "".join(single) + DELETED, "".join(single.values()))


def romanise_kmu(text: Column) -> Column:
    """The official scheme: зг is zgh, and five letters differ at the start of a word."""
    out = F.replace(F.lower(text), F.lit("зг"), F.lit("zgh"))
    # The letter before decides, so initial forms are marked while all other letters are still in place.
    for letter, (initial, medial) in POSITIONAL.items():
        out = F.regexp_replace(out, rf"(?<!\p{{L}}){letter}", f"\u0001{letter}")
    for letter, (initial, medial) in POSITIONAL.items():
        out = F.replace(F.replace(out, F.lit(f"\u0001{letter}"), F.lit(initial)), F.lit(letter), F.lit(medial))
    return _spell(out, SINGLE, SEVERAL)


def romanise_naive(text: Column) -> Column:
    """The way people type it: one spelling a letter."""
    return _spell(F.lower(text), SINGLE | TYPED_SINGLE, {k: v for k, v in (SEVERAL | TYPED_SEVERAL).items() if k not in TYPED_SINGLE})


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


ROMANISED = "array<struct<scheme: string, value: string>>"


def romanisations(text: Column) -> Column:
    """Array of (scheme, value): distinct romanisations of a Cyrillic text that differ from it, official first.

    Other texts cost one look for a Cyrillic letter.
    """
    pair = lambda scheme, value: F.struct(F.lit(scheme).alias("scheme"), value.alias("value"))

    def differing(t: Column) -> Column:
        both = F.array(pair("translit_kmu", t["kmu"]), F.when(t["naive"] != t["kmu"], pair("translit_naive", t["naive"])))
        return F.filter(both, lambda x: x.isNotNull() & (x["value"] != "") & (F.lower(x["value"]) != t["low"]))

    spelled = F.struct(F.trim(romanise_kmu(text)).alias("kmu"), F.trim(romanise_naive(text)).alias("naive"), F.lower(text).alias("low"))
    return F.when(is_cyrillic(text), bound(spelled, differing)).otherwise(F.array().cast(ROMANISED))
