"""What the training-data operators share: table reading, lineage cuts and literal tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.lineage import settle  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A broadcast list of ids has at most so many rows (8 bytes each); longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def row_keys(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two columns that name a row by all its values (128 bits of hashes; maps are left out), and their names.

    Rows that share a doc_id, or have none, are told apart; only equal rows have equal keys.
    """
    names = ["_row_key", "_row_check"]
    while set(names) & set(df.columns):
        names = ["_" + n for n in names]
    values = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    # xxhash64 passes nulls over; which values are null is hashed as well.
    nulls = F.concat(*(v.isNull().cast("int").cast("string") for v in values))
    return df.withColumns({names[0]: F.xxhash64(nulls, *values), names[1]: F.xxhash64(F.lit("check"), nulls, *values)}), names


def keep_rows(df: DataFrame, ids: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The rows of ``df`` whose ``keys`` (never null) are in ``ids`` (``left_semi``) or not (``left_anti``); ``ids`` is settled and distinct."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, keys, kind)


def sampled(rows: DataFrame, most: int, kind: str | None = None) -> DataFrame:
    """At most ``most`` distinct rows, of each value of the column ``kind`` if given: those with the smallest 64-bit hashes.

    Works alike at every size: the threshold has 64 bits, equal rows count once (and are put together before they are
    shuffled), and null columns are values like others.  The values of ``kind`` are few.
    """
    nulls = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in rows.columns))
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(7), nulls, *rows.columns))
    groups = [kind] if kind else []
    sizes = hashed.groupBy(*groups).agg(F.approx_count_distinct("_hash").alias("n")).collect()
    limit = F.lit(None).cast("bigint")
    for r in sizes:  # more than twice the sample, so that neither chance nor the error of the count matters
        bound = F.lit(min((2 * most + 64) * 2**64 // max(r["n"], 1), 2**64 - 1) - 2**63)
        limit = F.when(F.col(kind).eqNullSafe(r[kind]), bound).otherwise(limit) if kind else bound
    picked = hashed.where(F.col("_hash") <= limit).groupBy("_hash", *rows.columns).agg(F.count("*").alias("_many"))
    if not kind:
        return picked.orderBy("_hash", *rows.columns).limit(most).select(*rows.columns)
    order = Window.partitionBy(kind).orderBy("_hash", *(c for c in rows.columns if c != kind))
    return picked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).select(*rows.columns)


def lean(run):
    """An Arrow batch function that hands its freed memory back when its task ends; workers live on between tasks."""

    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def text_chunks(texts: Sequence[str], chars: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs (low, high) of whole texts of about so many characters, so that work on a batch stays small."""
    low, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield low, k
            low, size = k, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def literal_table(spark: SparkSession, rows: Iterable[Sequence], ddl: str) -> DataFrame:
    """A small table of ``rows`` as one folded literal: no RDD, no Python on the executors."""
    names = [field.strip().split()[0] for field in ddl.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows], ensure_ascii=False)
    shape = f"array<struct<{', '.join(f'{a}: {b}' for a, b in (f.strip().split() for f in ddl.split(',')))}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), shape)))


def literal_array(values: Sequence, element: str):
    """A constant array column that Catalyst folds once, for constant-time lookups by index."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element}>")
