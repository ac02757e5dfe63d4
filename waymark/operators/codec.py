"""The binary form of postings: blocks of delta-coded numbers, seven bits a byte, low bits first.

A block holds the refs of one word in one range of places: its first ref and its count are the skip entry,
and the body has the differences of each ref from the one before.  So a block is read without those before it, no block
is longer than its range, and a word that most places hold is many rows.  Written one after the other, each body behind the
difference of its first ref from the last one of the block before, the blocks of a word are its whole postings as one string of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.index import map_runs

MOST_BYTES = 9  # of a number below 2 ** 63


def to_bytes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of numbers that are not negative, and how many each takes."""
    if len(numbers) and numbers.min() < 0:
        raise ValueError("refs must ascend and must not be negative")
    sizes = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, MOST_BYTES))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        here = sizes > k
        out[starts[here] + k] = (numbers[here] >> 7 * k & 0x7F) | np.where(sizes[here] > k + 1, 0x80, 0)
    return out, sizes


def from_bytes(data: np.ndarray) -> np.ndarray:
    """The numbers that bytes hold."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    last = data < 0x80
    starts = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    owner = np.cumsum(np.r_[0, last[:-1]])
    shifts = 7 * (np.arange(len(data)) - starts[owner])
    return np.add.reduceat((data & 0x7F).astype(np.int64) << shifts, starts)


def _body(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column(3)
    refs, bounds = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    inner = np.ones(len(refs), dtype=bool)
    inner[bounds[:-1]] = False
    data, sizes = to_bytes(np.diff(refs, prepend=0)[inner])
    ends = np.zeros(len(refs) + 1, dtype=np.int64)
    ends[1:][inner] = sizes
    ends = np.cumsum(ends)[bounds]
    bodies = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])
    columns = [batch.column(0), batch.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(refs[bounds[:-1]]), pa.array(refs[bounds[1:] - 1]), bodies]
    return pa.RecordBatch.from_arrays(columns, names=["word", "range", "places", "first", "last", "body"])


def encode(pairs: DataFrame) -> DataFrame:
    """(word, range, places, first, last, body) for ``pairs`` (word, place_id, named)."""
    return map_runs(pairs.where("place_id is not null"), _body, "word string, range bigint, places bigint, first bigint, last bigint, body binary")


def decode(blocks: DataFrame, *also: str) -> DataFrame:
    """(word, range, postings) for ``blocks`` (word, range, places, first, body), and the columns ``also`` as they are."""
    kept = blocks.select("word", "range", *also, F.col("places").alias("_n"), F.col("first").alias("_first"), "body")
    fields = [*kept.schema.fields[: 2 + len(also)], T.StructField("postings", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, places, firsts, body = batch.columns
            counts, first = places.to_numpy(), firsts.to_numpy()
            data = np.frombuffer(b"".join(body.to_pylist()), dtype=np.uint8)
            bounds = np.r_[0, np.cumsum(counts)]
            steps = np.zeros(bounds[-1], dtype=np.int64)
            inner = np.ones(len(steps), dtype=bool)
            inner[bounds[:-1]] = False
            steps[inner] = from_bytes(data)
            total = np.cumsum(steps)
            refs = total + np.repeat(first - total[bounds[:-1]], counts)
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(refs))], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def head_bytes(step):
    """The bytes of a head, as an expression."""
    part = lambda k: F.shiftright(step, 7 * k).bitwiseAND(F.lit(0x7F))
    more = lambda k: F.when(F.shiftright(step, 7 * (k + 1)) > 0, F.lit(0x80)).otherwise(F.lit(0))
    digits = (F.when((step >= 1 << 7 * k) if k else F.lit(True), F.lpad(F.hex(part(k) + more(k)), 2, "0")).otherwise("") for k in range(MOST_BYTES))
    return F.unhex(F.concat(*digits))


def streams(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``data``: the block's part of the word's whole postings, head and body.

    The blocks of a word are put in order, one for each range of places that holds it; each passes by once.
    """
    along = Window.partitionBy("word").orderBy("range")
    step = F.col("first") - F.coalesce(F.lag("last").over(along), F.lit(0))
    return blocks.withColumn("step", step).withColumn("data", F.concat(head_bytes(F.col("step")), "body")).drop("step")
