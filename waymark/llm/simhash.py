"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; bit b is set if it is set in more than half of the XXH64 hashes of the
text's word shingles.  Two texts are linked if their fingerprints differ in at most ``RADIUS`` bits.

Ball hashing of whole fingerprints emits every variant within half the radius, rounded down on one
side and up on the other: 65 and 2081 variants of each, which is far more than the corpus itself.  The
radius is therefore first split over the two 32-bit halves: within distance 3 one half differs in at
most 1 bit.  Half of that radius, rounded down and up, is 0 and 1, so every fingerprint emits each half
as it is and all 32 one-bit variants of it: 66 narrow rows.  Rows meet by a shuffle on (half, variant);
colliding pairs are verified by their whole distance and deduplicated.

A half that more than ``crowd`` fingerprints share would make pairs by the square of its size.  All
fingerprints at or around such a half go through the balls of whole fingerprints instead: whoever shares
a variant within (1, 2) bits is within the radius, so each hangs on one hub of the variant and no pair
is formed.  No link is lost either way, and nothing is capped.

Equal fingerprints are one node.  Components come from alternating star steps.

Defined results: a null text is an empty one, with fingerprint 0, linked like any other; texts of fewer
words than a shingle are one shingle; rows of equal text share a fingerprint; null doc_ids take part but
are never the smallest; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import keep_rows, lean, row_keys, settle, table
from waymark.llm.components import components

SHINGLE, SEED, RADIUS, CROWD = 3, 42, 3, 64


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return 0
    parts = [found] if len(found) <= words else zip(*(found[k:] for k in range(words)), strict=False)
    hashes = np.array([xxh64_intdigest(b" ".join(p), SEED) for p in parts], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and the columns ``carry``) for every row; fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), *batch.columns[2:]], names=["doc_id", "fp", *carry])

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    more = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(lean(run), "doc_id bigint, fp bigint" + more)


def _halves(nodes: DataFrame) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    return nodes.select("fp", F.posexplode(F.array(low, F.shiftrightunsigned("fp", 32))).alias("half", "own"))


def _masks(least: int, most: int) -> list[int]:
    """All 64-bit masks with ``least`` to ``most`` bits set, as signed numbers."""
    found = (sum(1 << b for b in bits) for n in range(least, most + 1) for bits in combinations(range(64), n))
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _whole_balls(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) among ``nodes`` that connect all within the radius, by hubs of shared variants.

    A fingerprint within half the radius (rounded down) of a variant and another within half of it
    (rounded up) are within the radius of each other, so every link to a hub is a true one.
    """
    inner, outer = radius // 2, (radius + 1) // 2
    rows = [
        nodes.select("fp", F.lit(near).alias("near"), F.explode(F.array(*map(F.lit, masks))).alias("mask"))
        for near, masks in ((True, _masks(0, inner)), (False, _masks(inner + 1, outer)))
        if masks
    ]
    rows = reduce(DataFrame.unionByName, rows).select("fp", "near", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    hubs = rows.where("near").groupBy("variant").agg(F.min("fp").alias("hub"))
    return rows.join(hubs, "variant").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def ball_links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect any two distinct fingerprints of ``nodes`` within ``radius`` bits (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves with balls of one bit reach a radius of at most 3")
    own = _halves(nodes)
    crowded = settle(own.groupBy("half", "own").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("half", "own"))
    masks = F.array(F.lit(0), *(F.lit(1 << b) for b in range(32)))
    probes = own.select("half", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("own"), F.col("fp").alias("b"))
    probes = probes.select("half", "own", "b")
    index = own.select("half", "own", F.col("fp").alias("a"))
    if found := crowded.count():
        index = index.join(crowded, ["half", "own"], "left_anti")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    links = index.join(probes, ["half", "own"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    if found:
        around = probes.join(crowded, ["half", "own"], "left_semi").select(F.col("b").alias("fp")).distinct()
        links = links.unionByName(_whole_balls(settle(around), radius))
    return links


def near_duplicates(df: DataFrame, words: int = SHINGLE, radius: int = RADIUS, crowd: int = CROWD, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root, and ``carry``) for every row.

    component_id is the smallest doc_id reachable; root is the same fingerprint for all of a component.
    """
    docs = settle(fingerprints(df, words, carry))
    nodes = settle(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = settle(components(ball_links(nodes.select("fp"), radius, crowd)))
    linked = settle(nodes.join(roots, nodes.fp == roots.node).select("fp", "first", "root"))
    least = settle(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    labels = linked.join(least, "root").select("fp", "component_id", "root")
    single = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"), F.col("fp").alias("root"))
    return docs.join(settle(labels.unionByName(single)), "fp").select("doc_id", "fp", "component_id", "root", *carry)


def representatives(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of the smallest doc_id (null last), then by a hash of the row.

    Rows are told apart by all their values, so that rows without a doc_id, or with one in common, are
    judged each by its own text.
    """
    keyed, keys = row_keys(docs)
    found = settle(near_duplicates(keyed, words, radius, carry=tuple(keys)))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", *keys)
    groups = settle(found.groupBy("root").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", *(F.col(f"best.{k}").alias(f"best{j}") for j, k in enumerate(keys))))
    others = found.join(groups, "root").where((F.col(keys[0]) != F.col("best0")) | (F.col(keys[1]) != F.col("best1")))
    kept = keep_rows(keyed, settle(others.select(*keys).distinct()), keys, "left_anti")
    # Equal rows have equal keys: of the best one, too, only one copy stays.
    repeated = settle(found.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    if repeated.count():
        kept = keep_rows(kept, repeated, keys, "left_anti").unionByName(keep_rows(kept, repeated, keys, "left_semi").dropDuplicates(keys))
    return kept.drop(*keys)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
