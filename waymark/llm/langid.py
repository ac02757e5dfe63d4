"""Language identification as a mixture: which languages a document holds, and in what proportions.

Every learned language has a letter-trigram model (hashed into ``BUCKETS`` counts, smoothed).  The
words of a document are drawn from a mixture of languages; expectation-maximisation estimates the
proportions from the words' trigram likelihoods.  Language sets are nested by their proportions and the
set with the best penalised likelihood (log-likelihood minus ``PENALTY`` * size * ln(words)) is kept: a
document's set grows, up to all learned languages, as long as a further one improves that value.

The models learn from at most ``SAMPLE`` distinct training texts a language, taken by hash and
counted on the executors; only the counts (``BUCKETS`` numbers a language) reach the driver.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text whose
trigrams are all unknown gets the language with the most even fit (the first learned) and its share;
with no training rows everything is ``und``; input columns called like an output are replaced; other
columns are passed through; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._common import lean, sampled, settle, table, text_chunks

BUCKETS, SAMPLE, ROUNDS, PENALTY, UNKNOWN = 1 << 16, 1500, 8, 2.0, "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point 0 if it is no letter, else its lower-case code point."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each letter's trigram, where each word starts among them, and the text of each word."""
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbol = np.zeros(len(code) + 2, dtype=np.int64)
    symbol[1:-1] = _letters()[code]
    at = np.flatnonzero(symbol)
    before, here, after = symbol[at - 1], symbol[at], symbol[at + 1]
    mixed = (before * 0x9E3779B1 + here * 0x85EBCA77 + after * 0xC2B2AE3D) & 0xFFFFFFFF
    mixed ^= mixed >> 15
    bucket = ((mixed * 0x2C1B3C6D) & 0xFFFFFFFF) >> 16
    starts = np.flatnonzero(before == 0)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return bucket, starts, np.searchsorted(ends, at[starts] - 1, side="right")


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of trigram buckets, one column for each language."""

    languages: tuple[str, ...]
    table: np.ndarray

    def mixtures(self, texts: list[str], rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
        """The proportions of the chosen language set for each text; all zero where it has no letter."""
        out = np.zeros((len(texts), len(self.languages)))
        if not self.languages or not texts:
            return out
        bucket, starts, owner = _trigrams(texts)
        if not len(starts):
            return out
        fit = np.add.reduceat(self.table[bucket], starts, axis=0)
        best = fit.max(axis=1, keepdims=True)
        likely = np.exp(fit - best)
        docs, first, words = np.unique(owner, return_index=True, return_counts=True)
        row = np.repeat(np.arange(len(docs)), words)

        def improve(share: np.ndarray, times: int, likely: np.ndarray, row: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
            for _ in range(times):
                part = share[row] * likely
                part /= part.sum(axis=1, keepdims=True)
                share = np.add.reduceat(part, first, axis=0) / words[:, None]
            return share

        share = improve(np.full((len(docs), len(self.languages)), 1 / len(self.languages), dtype=likely.dtype), rounds, likely, row, first, words)
        order = np.argsort(-share, axis=1, kind="stable")
        chosen, value = np.zeros_like(share), np.full(len(docs), -np.inf)
        open_ = np.arange(len(docs))  # the documents whose sets still grow; the others' words are left out
        for size in range(1, len(self.languages) + 1):
            inside = np.zeros((len(open_), share.shape[1]), dtype=share.dtype)
            np.put_along_axis(inside, order[open_, :size], 1, axis=1)
            trial = np.maximum(share[open_], 1e-6) * inside
            trial /= trial.sum(axis=1, keepdims=True)
            if size > 1:
                trial = improve(trial, 3, likely, row, first, words)
            gained = np.log(np.maximum((trial[row] * likely).sum(axis=1), 1e-30), dtype=np.float64)
            worth = np.add.reduceat(gained, first) - penalty * size * np.log(words + 1)
            better = worth > value[open_]
            chosen[open_[better]], value[open_[better]] = trial[better], worth[better]
            if not better.any():
                break
            if not better.all():
                kept = better[row]
                open_, likely, words = open_[better], likely[kept], words[better]
                first = np.concatenate([[0], np.cumsum(words)[:-1]])
                row = np.repeat(np.arange(len(open_)), words)
        out[docs] = chosen
        return out


def train(labelled: DataFrame, sample: int = SAMPLE, smoothing: float = 0.5) -> LanguageModel:
    """Learn from ``labelled`` (text, lang), at most ``sample`` distinct texts a language."""
    picked = settle(sampled(labelled.where("lang is not null and text is not null").select("lang", "text"), sample, "lang"))
    languages = tuple(sorted(r["lang"] for r in picked.select("lang").distinct().collect()))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), dtype=np.float32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for low, high in text_chunks(own):
                    bucket = _trigrams(own[low:high])[0]
                    totals[lang] = totals.get(lang, 0) + np.bincount(bucket, minlength=BUCKETS)
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals)), pa.array([v.astype("<i8").tobytes() for v in totals.values()], pa.binary())], names=["lang", "counts"]
            )

    counts = {x: np.zeros(BUCKETS, dtype=np.int64) for x in languages}
    # The sample is bounded, so a few tasks hold it and a few count tables come back.
    for r in picked.select("text", "lang").repartition(4).mapInArrow(lean(count), "lang string, counts binary").collect():
        counts[r["lang"]] += np.frombuffer(r["counts"], dtype="<i8")
    matrix = np.stack([counts[x] for x in languages], axis=1) + smoothing
    return LanguageModel(languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def identify(df: DataFrame, model: LanguageModel) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (that language's share) and ``mixture`` (JSON of the chosen set)."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "mixture")]
    df = df.select(*kept)
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("mixture", T.StringType())))])
    where = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            parts = [known.mixtures(texts[low:high]) for low, high in text_chunks(texts)]
            mix = np.concatenate(parts) if parts else np.zeros((0, len(known.languages)))
            if known.languages:
                top, score = mix.argmax(axis=1), mix.max(axis=1)
            else:
                top = score = np.zeros(len(texts))
            pred = [known.languages[k] if s > 0 else UNKNOWN for k, s in zip(top, score, strict=True)]
            said = [json.dumps({known.languages[k]: round(float(m[k]), 6) for k in np.flatnonzero(m > 0)}) for m in mix]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(said, pa.string())],
                names=[*batch.schema.names, "lang_pred", "score", "mixture"],
            )

    return df.mapInArrow(lean(run), schema)


def held_out():
    """True for the documents that the models never learn from."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(~F.coalesce(held_out(), F.lit(False))).select("doc_id", "text", "lang"))
    judged = identify(documents.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "mixture")
