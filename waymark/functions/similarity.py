"""Word similarity: prefixes and containment in the JVM, the block ratio only for what is left."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.blocks import ratios
from waymark.schema import SearchParams


@F.pandas_udf(T.DoubleType())
def block_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matched characters over all characters, matching longest blocks first (no junk heuristics); null for null words."""
    for word, candidate in pairs:
        known = word.notna() & candidate.notna()
        out = pd.Series(float("nan"), index=word.index, dtype="float64").astype(object).where(known, None)
        out[known] = ratios(word[known].tolist(), candidate[known].tolist())
        yield out.astype("Float64")


def ratio_bound(word: Column, candidate: Column) -> Column:
    """What the block ratio cannot exceed: twice the characters that both words have, wherever they stand, over all characters."""
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, sign, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(word, "")), F.lit(0), lambda n, sign: n + F.least(count(word, sign), count(candidate, sign)))
    return 2.0 * shared / F.greatest(F.length(word) + F.length(candidate), F.lit(1))


def quick_score(word: Column, candidate: Column, params: SearchParams = SearchParams()) -> Column:
    """The similarity where no ratio is needed, else null."""
    gap = F.abs(F.length(word) - F.length(candidate)) > params.max_length_gap
    return F.when(candidate.startswith(word), 1.0).when(F.contains(candidate, word), 0.9).when(gap, 0.0)


def score_pairs(pairs: DataFrame, word: str = "word", candidate: str = "candidate", params: SearchParams = SearchParams(), least: Column | None = None) -> DataFrame:
    """``pairs``, which are distinct, with ``score``; only those that need the ratio are sent to Python.

    With ``least`` scores below it are of no use: pairs that cannot reach it score 0 without a ratio.
    """
    known = quick_score(F.col(word), F.col(candidate), params)
    if least is not None:
        known = F.coalesce(known, F.when(ratio_bound(F.col(word), F.col(candidate)) < least, 0.0))
    quick = pairs.withColumn("_quick", known)
    open_ = F.col("_quick").isNull()
    ratio = block_ratio(F.when(open_, F.col(word)), F.when(open_, F.col(candidate)))
    return quick.withColumn("score", F.coalesce("_quick", ratio)).drop("_quick")
