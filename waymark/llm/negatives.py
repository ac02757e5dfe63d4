"""Hard negatives by a full sort of each anchor's scores.

Vectors are made integer (``floor(256 * x)`` of each component), so that scores are exact and ties are ties.
For every anchor all rows are scored and sorted by (score descending, id ascending).  An upper limit of a
positive is found in that order by binary search, and from there the first ``k`` entries of another label
are read for as long as they keep the lower limit.

Rows are never shuffled: the anchors, a stated set of queries, go to the rows in blocks of at most about
``ANCHORS`` (some more by chance of the hash), each block a pass over the table.  A task scores and sorts at most ``ROWS`` rows at a time; the first
``k`` of a whole order are among the first ``k`` of its parts, so a task hands on ``k`` rows for each anchor
and positive and the parts' rows are ranked once more.  Only a block's anchors and its few positives pass
through the driver, so more rows or more anchors mean more passes and never more memory.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part;
a null vec_id is never an anchor and comes last among ties; rows that repeat a vec_id count each, but
never for an anchor of that vec_id; anchors that are equal in vec_id, label and vector are one anchor, and others that share a
vec_id are listed each; rows whose vectors differ in length from the anchor's do not meet it; scores beyond 64 bits are
taken for the largest such number; an anchor without positives, or a positive without negatives, gives no
rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import lean, settle, table

SCALE, ANCHOR_STEP, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 5, 10, 30, 90
ANCHORS, ROWS, CELLS, NO_ID = 2048, 1 << 16, 1 << 22, np.iinfo(np.int64).max


def quantised(df: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; the vector is made of integers."""
    rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.where("label is not null and vector is not null").where(sound)
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE).cast("bigint")))


@dataclass(frozen=True)
class Block:
    """Anchors of one pass, with their positives once these are known (one list an anchor)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: list[np.ndarray]
    positives: list[list[tuple[int, int | None]]]


def _rows(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors as a matrix) of at most ``most`` rows with vectors of one length, sorted by id."""

    def sized(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        labels, lists = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        offsets = lists.offsets.to_numpy()
        flat, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            yield ids[own], labels[own], flat[offsets[own][:, None] + np.arange(size)]

    waiting: dict[int, list] = {}

    def whole(size: int):
        ids, labels, vectors = (np.concatenate(x) for x in zip(*waiting.pop(size), strict=True))
        order = np.lexsort((labels, ids))
        return ids[order], labels[order], vectors[order]

    for batch in batches:
        for part in sized(batch):
            size = part[2].shape[1]
            if sum(len(x[0]) for x in waiting.get(size, ())) + len(part[0]) > most and size in waiting:
                yield whole(size)
            waiting.setdefault(size, []).append(part)
    for size in list(waiting):
        yield whole(size)


def _scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors with all rows."""
    largest = float(np.abs(anchors.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * anchors.shape[1]
    if largest < 2**53:  # floating point numbers hold each sum exactly
        return (anchors.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -NO_ID, NO_ID).astype(np.int64)


def sorted_scores(anchors: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the scores in descending order and the places of their rows; equal scores keep the rows' order."""
    scores = _scores(anchors, vectors)
    bits = max(1, (vectors.shape[0] - 1).bit_length())
    if int(np.abs(scores.astype(float)).max(initial=0)) < 1 << (61 - bits):
        keys = (-scores << bits) | np.arange(vectors.shape[0])  # one number a row: sorting it sorts by score, then by place
        keys.sort(axis=1)
        return -(keys >> bits), keys & ((1 << bits) - 1)
    places = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(scores, places, axis=1), places


@dataclass
class Best:
    """The first ``k`` (score, id) for each key seen so far."""

    k: int
    found: list

    def add(self, keys, scores, ids) -> None:
        self.found.append((np.asarray(keys, dtype=np.int64), np.asarray(scores, dtype=np.int64), np.asarray(ids, dtype=np.int64)))
        if len(self.found) > 4096:
            self.found = [self.first()]

    def first(self):
        if not self.found:
            return (np.zeros(0, dtype=np.int64),) * 3
        keys, scores, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=int)
        kept = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)])) < self.k
        return keys[kept], scores[kept], ids[kept]


def positives_of(block: Block, k: int, at: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places in the order) of the first ``k`` other rows of the anchor's label."""
    yield at, np.flatnonzero((labels == block.labels[at]) & (ids != block.ids[at]))[:k]


def negatives_of(block: Block, k: int, low: int, high: int, at: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places in the order) of the first ``k`` rows of another label within each positive's limits."""
    others = np.flatnonzero(labels != block.labels[at])
    down = -scores[others]
    for p, (score, _) in enumerate(block.positives[at]):
        top, least = high * score // 100, -(-low * score // 100)
        begin = int(np.searchsorted(down, max(-top, -NO_ID), side="left"))
        read = others[begin : begin + k]
        yield at * POSITIVES + p, read[scores[read] >= least]


def _pass(rows: DataFrame, block: Block, k: int, pick: Callable) -> DataFrame:
    """(key, score, vec_id): what ``pick`` finds for the block's anchors, at most ``k`` a key and task."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # at most about ANCHORS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = shared.value, Best(k, [])
        by_size: dict[int, list[int]] = {}
        for at, vector in enumerate(known.vectors):
            by_size.setdefault(len(vector), []).append(at)
        for ids, labels, vectors in _rows(batches):
            own = by_size.get(vectors.shape[1], [])
            step = max(1, CELLS // len(ids))
            for low in range(0, len(own), step):
                part = own[low : low + step]
                scores, places = sorted_scores(np.stack([known.vectors[at] for at in part]), vectors)
                for at, line, order in zip(part, scores, places, strict=True):
                    for key, found in pick(known, k, at=at, scores=line, ids=ids[order], labels=labels[order]):
                        if len(found):
                            best.add(np.full(len(found), key), line[found], ids[order[found]])
        keys, scores, ids = best.first()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(scores), pa.array(ids, mask=ids == NO_ID)], names=["key", "score", "vec_id"])

    return rows.mapInArrow(lean(run), "key bigint, score bigint, vec_id bigint")


def _ranked(found: DataFrame, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order))


def mine(df: DataFrame, step: int = ANCHOR_STEP, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, at_once: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``df`` (vec_id, embedding, label).

    Anchors are the rows whose vec_id ``step`` divides; ``low`` and ``high`` are the limits in hundredths of the positive's score.
    """
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives an anchor")
    spark, rows = df.sparkSession, quantised(df)
    anchors = settle(rows.where(F.col("vec_id") % step == 0).distinct())
    blocks = -(-anchors.count() // at_once)
    result = "block int, key bigint, score bigint, vec_id bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
    passes = []
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == b).toPandas()
        block = Block(own["vec_id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), [np.asarray(v, dtype=np.int64) for v in own["vector"]], [[] for _ in range(len(own))])
        first = _ranked(_pass(rows, block, positives, positives_of), "key").where(F.col("rank") <= positives)
        for r in sorted(first.collect(), key=lambda r: (r["key"], r["rank"])):  # a few an anchor of the block
            block.positives[r["key"]].append((r["score"], r["vec_id"]))

        def pick(block, k, **line):
            return negatives_of(block, k, low, high, **line)

        known = [(k * POSITIVES + p, int(block.ids[k]), i, s) for k, some in enumerate(block.positives) for p, (s, i) in enumerate(some)]
        if known:
            names = F.broadcast(spark.createDataFrame(known, "key bigint, anchor_id bigint, positive_id bigint, positive_score bigint"))
            passes.append(_pass(rows, block, negatives, pick).join(names, "key").select(F.lit(b).alias("block"), "key", "score", "vec_id", "anchor_id", "positive_id", "positive_score"))
    found = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], result)
    last = _ranked(found, "block", "key").where(F.col("rank") <= negatives)
    return last.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")))


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (
  select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
