"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame operations only).

Every shard owns ``vnodes`` points on a ring of ``slots`` places.  A row hashes to a place and walks
clockwise to the next point.  A shard takes rows up to its bound; rows beyond it go on clockwise to
the next shard that still has room, so balance is guaranteed and only overflowing rows move.

The default bounds are the exact quotas (counts at most one apart); with ``load_factor`` c they are
``ceil(c * n / shards)``.  Only the number of rows per arc (``shards * vnodes`` numbers, however large
the table) reaches the driver, where the walk is done on counts.  Rows keep their arc and get their
rank within it, and a small segment table turns (arc, rank) into (shard, slot): one shuffle of narrow
rows, no text is moved.  Ranks are counted within (arc, salt) cells, the salt being a hash of the whole row,
so that a key that very many rows share does not meet in one task.

Defined results: a null text has size 1 and CRC 0; a null doc_id is a key like any other; equal
rows are ordered arbitrarily among themselves, which no output shows; an empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import literal_array, literal_table, settle, table

SHARDS, VNODES, SLOTS, SALTS = 8, 256, 1 << 16, 64


def ring(shards: int, vnodes: int = VNODES, slots: int = SLOTS) -> list[tuple[int, int]]:
    """The sorted points (place, shard).  Points of a shard do not depend on the number of shards."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            place = int(hashlib.md5(f"shard {shard} point {v}".encode()).hexdigest()[:8], 16) % slots
            points.setdefault(place, shard)  # a later shard never takes a place from an earlier one
    return sorted(points.items())


def arcs_by_place(points: list[tuple[int, int]], slots: int) -> list[int]:
    """For every place the index of the next point clockwise."""
    out, k = [], 0
    for place in range(slots):
        while k < len(points) and points[k][0] < place:
            k += 1
        out.append(k % len(points))
    return out


def bounds(total: int, shards: int, load_factor: float | None) -> list[int]:
    if load_factor is None:
        return [total // shards + (s < total % shards) for s in range(shards)]
    if load_factor < 1:
        raise ValueError("load_factor must be at least 1")
    return [math.ceil(load_factor * total / shards)] * shards


def walk(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot): home rows first, then overflow clockwise."""
    room, filled, segments, overflow = list(room), [0] * len(room), [], []

    def put(arc: int, low: int, high: int, shard: int) -> int:
        take = min(high - low, room[shard])
        if take:
            segments.append((arc, low, low + take, shard, filled[shard]))
            room[shard] -= take
            filled[shard] += take
        return low + take

    for arc in sorted(counts):
        if (low := put(arc, 0, counts[arc], points[arc][1])) < counts[arc]:
            overflow.append((arc, low, counts[arc]))
    for arc, low, high in overflow:
        step = 1
        while low < high:
            low = put(arc, low, high, points[(arc + step) % len(points)][1])
            step += 1
    return segments


def place_of(key: str = "doc_id", slots: int = SLOTS):
    """The ring place of a key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int")


def ring_owner(df: DataFrame, shards: int, vnodes: int = VNODES, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """The ring without bounds: ``df`` with ``shard``; one more shard takes rows only into itself."""
    points = ring(shards, vnodes, slots)
    owners = [points[arc][1] for arc in arcs_by_place(points, slots)]
    return df.withColumn("shard", F.get(literal_array(owners, "int"), place_of(key, slots)))


def shard_bounded(
    df: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slots: int = SLOTS,
    load_factor: float | None = None, key: str = "doc_id", order: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with ``shard`` and the gapless ``slot`` in it, under bounded loads.

    ``order`` names further columns that break ties between rows of equal key.  Columns of ``df`` called
    ``shard`` or ``slot`` are replaced.
    """
    rows = df.drop("shard", "slot")
    points = ring(shards, vnodes, slots)
    arc = F.get(literal_array(arcs_by_place(points, slots), "int"), place_of(key, slots))
    hashed = [f.name for f in rows.schema.fields if "map" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in hashed)), F.lit(SALTS)).cast("int")
    placed = rows.withColumns({"_arc": arc, "_salt": salt, "_place": place_of(key, slots)})
    cells = settle(placed.groupBy("_arc", "_salt").agg(F.count("*").alias("_n")))
    counts = {r["_arc"]: r["n"] for r in cells.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    segments = walk(counts, points, bounds(sum(counts.values()), shards, load_factor))
    plan = literal_table(df.sparkSession, segments, "_arc int, _low bigint, _high bigint, _shard int, _first bigint")
    before = Window.partitionBy("_arc").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("_arc", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_arc", "_salt").orderBy("_place", key, *order)
    ranked = placed.withColumn("_row", F.row_number().over(inside) - F.lit(1))
    # Both small sides have proven bounds: shards * vnodes * SALTS cells, and a few segments for each arc.
    joined = (
        ranked.join(F.broadcast(base), ["_arc", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_row"))
        .join(F.broadcast(plan), "_arc").where("_rank >= _low and _rank < _high")
    )
    return joined.withColumns({"shard": F.col("_shard"), "slot": F.col("_first") + F.col("_rank") - F.col("_low")}).drop(
        "_arc", "_salt", "_place", "_row", "_base", "_rank", "_low", "_high", "_shard", "_first"
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``rows``: counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + F.lit(1)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard_bounded(rows, order=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
