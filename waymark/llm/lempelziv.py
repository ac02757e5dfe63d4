"""Lempel-Ziv phrase fingerprints: texts that a dictionary coder would find alike have like signatures.

A text is read as symbols (runs of up to ``RUN`` word characters, and single other signs; white space
only parts them) and parsed into dictionary phrases as LZ78 does: the longest known phrase plus one
symbol becomes a new phrase.  The set of phrase hashes is summed up by ``SIGNATURE`` minimum hashes.
Of each minimum the low 16 bits are kept; the share of equal ones estimates the Jaccard likeness of two
phrase sets and depends on the fingerprints alone.

Defined results: null and empty texts have the empty phrase set, whose minima are all the largest
number, and are wholly alike; equal texts have equal fingerprints; repeated rows are separate
documents, ordered by doc_id and, of one doc_id, by a hash of the text and then the text; null doc_ids count
as the lowest; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._common import lean, literal_table, table

SIGNATURE, RUN, RANGES, RANGE_CHARS = 64, 8, 1024, 1 << 28
SYMBOL = re.compile(rf"\w{{1,{RUN}}}|[^\w\s]")
_MASK, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15
_NONE = np.full(SIGNATURE, _MASK, dtype=np.uint64)
_TURNS = np.random.default_rng(8).integers(1, 1 << 63, size=(2, SIGNATURE), dtype=np.uint64)
_TURNS[0] |= np.uint64(1)


class Parser:
    """LZ78 over symbols, with the hashes of symbols kept for a worker's life (bounded)."""

    def __init__(self, most: int = 500_000):
        self.symbols: dict[str, int] = {}
        self.most = most

    def hashes(self, symbols: list[str]) -> list[int]:
        known = self.symbols
        if len(known) > self.most:
            known.clear()
        for s in set(symbols).difference(known):
            known[s] = int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return [known[s] for s in symbols]

    def parse(self, symbols: list[str], phrases: set[int], at: int = 0) -> tuple[list[int], int]:
        """New phrases in turn, added to ``phrases``; ``at`` is the phrase in progress (0: none)."""
        new = []
        for h in self.hashes(symbols):
            at = ((at ^ h) * _STEP) & _MASK
            at ^= at >> 29
            if at not in phrases:
                phrases.add(at)
                new.append(at)
                at = 0
        return new, at


def minima(phrases: list[int], at: int = 0) -> np.ndarray:
    """The minimum hashes of a phrase list; ``at``, a last phrase cut short, is a known one and adds nothing."""
    out = _NONE.copy()
    values = np.array(phrases, dtype=np.uint64)
    for k in range(0, len(values), 4096):
        turned = values[k : k + 4096, None] * _TURNS[0] + _TURNS[1]
        turned ^= turned >> np.uint64(32)
        np.minimum(out, turned.min(axis=0), out=out)
    return out


def shared_start(text: str, cut: int) -> tuple[list[str], int]:
    """Symbols of ``text`` that anything after ``cut`` cannot change, and where they end."""
    symbols = SYMBOL.findall(text[:cut])
    if symbols and text.endswith(symbols[-1], 0, cut):
        last = symbols.pop()
        return symbols, cut - len(last)
    return symbols, cut


def signature(parser: Parser, text: str) -> np.ndarray:
    return minima(parser.parse(SYMBOL.findall(text), set())[0])


def shown(sign: np.ndarray) -> str:
    """A signature as hexadecimal text: the low 16 bits of each minimum."""
    return (sign & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places of two fingerprints, given as signatures."""
    return float((((a ^ b) & np.uint64(0xFFFF)) == 0).mean())


def fingerprint(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with ``fingerprint``, the signature of each whole text."""
    kept = df.drop("fingerprint")
    where = kept.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            made = [shown(signature(parser, t or "")) for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(lean(run), T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.StringType())]))


def spans(keys: np.ndarray, signs: np.ndarray, quantiles: list[int]) -> np.ndarray:
    """The range of each (doc_id, hash of the text), highest doc_ids first.

    A doc_id that several quantiles fall on is dealt over as many ranges, by its hashes.
    """
    values, many = np.unique(np.array(quantiles, dtype=np.int64), return_counts=True)
    parts = np.where(many > 1, many, 0)
    # Ascending: a range from each value on, and before it those of its own rows if it is hot.
    first = np.concatenate([[0], np.cumsum(1 + parts)])
    low, high = np.searchsorted(values, keys, side="left"), np.searchsorted(values, keys, side="right")
    own = np.append(parts, 0)[low]
    hot = (high > low) & (own > 0)
    up = np.where(hot, first[low] + 1 + ((signs >> 31) * own >> 32), first[high])
    return first[-1] - up


def in_order(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, guest) dealt so that each row is followed, in its partition, by the next document.

    Documents are ordered by descending doc_id, then hash of the text and text; after the last comes the first.
    Ranges are cut at approximate quantiles of doc_id, at least ``RANGES`` and one for ``RANGE_CHARS``
    characters unless ``ranges`` says how many.  The first row of each range also goes, as a guest, to the end
    of the range before it: a row for each range (and its like, if a row is repeated).
    """
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if ranges is None:
        ranges = max(RANGES, -(-(rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // RANGE_CHARS))
    key, sign = F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    found = rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], max(10_000, 2 * ranges))).first()[0]

    @F.pandas_udf("bigint")
    def span(keys: pd.Series, signs: pd.Series) -> pd.Series:
        return pd.Series(spans(keys.to_numpy(), signs.to_numpy(), found or []))

    keyed = rows.withColumns({"_key": key, "_sign": sign}).withColumn("_range", span("_key", "_sign"))
    # At most two rows for each of the ranges.
    first = F.max(F.struct("_key", "_sign")).alias("first")
    firsts = keyed.groupBy("_range").agg(first).orderBy("_range").collect()
    guests = [(r["first"]["_key"], r["first"]["_sign"], firsts[k - 1]["_range"]) for k, r in enumerate(firsts)]
    doors = literal_table(df.sparkSession, guests, "_key bigint, _sign bigint, _before bigint")
    dealt = keyed.join(F.broadcast(doors), ["_key", "_sign"], "left").select(
        "doc_id", "text", "_key", "_sign", F.posexplode(F.array_compact(F.array("_range", "_before"))).alias("_guest", "_range")
    )
    return (
        dealt.repartition("_range")
        .sortWithinPartitions("_range", "_guest", F.col("_key").desc(), F.col("_sign").desc(), "text")
        .select("doc_id", "text", (F.col("_guest") > 0).alias("guest"))
    )


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def compare_edited(ordered: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last third is the next document's start."""

    def judge(parser: Parser, doc: tuple, following: tuple | None) -> tuple:
        (doc_id, text), (cut, phrases, at, base, end, sign) = doc[:2], doc[2:]
        edited = text[:cut] + (following[1][: len(text) - cut])
        other = np.minimum(base, minima(parser.parse(SYMBOL.findall(edited[end:]), phrases, at)[0]))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, shown(sign), shown(other), likeness(sign, other), likeness(sign, following[-1])

    def read(parser: Parser, doc_id: int | None, text: str) -> tuple:
        cut = len(text) - len(text) // 3
        symbols, end = shared_start(text, cut)
        phrases: set[int] = set()
        start, at = parser.parse(symbols, phrases)
        base = minima(start)
        tail = parser.parse(SYMBOL.findall(text[end:]), set(phrases), at)[0]
        return doc_id, text, cut, phrases, at, base, end, np.minimum(base, minima(tail))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, held = Parser(), None
        for batch in batches:
            out = []
            for doc_id, text, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc = read(parser, doc_id, text)
                if held is not None:
                    out.append(judge(parser, held, doc))
                held = None if guest else doc
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in EDITED.split(",")])

    return ordered.mapInArrow(lean(run), EDITED)


def op8_lempelziv(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return compare_edited(in_order(table(spark, sf_dir, "documents")))
