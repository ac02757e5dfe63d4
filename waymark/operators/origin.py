"""Which origin a query sees, and which of many events count: as-of joins, debouncing, throttling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _period(column: str = "ts", unit: str = "day"):
    """Windows run within a period of a key, and only one row for each period is carried on: no key meets in one task."""
    return F.date_trunc(unit, column)


def _asof(left: DataFrame, right: DataFrame, value: str, tie: str, key: str, unit: str, name: str) -> DataFrame:
    """``left`` with ``name``, the struct ``value`` of the latest row of ``right`` at or before it; of equal times the larger ``tie``."""
    asked = left.withColumn("_left", F.struct(*left.columns)).select(key, "ts", F.lit(1).alias("_side"), "_left", F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(None).cast("bigint").alias("_tie"))
    seen = right.select(key, "ts", F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_left"].dataType).alias("_left"), F.col(value).alias("_value"), F.col(tie).cast("bigint").alias("_tie"))
    rows = asked.unionByName(seen).withColumn("_period", _period(unit=unit))
    inside = Window.partitionBy(key, "_period").orderBy("ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn(name, F.last("_value", ignorenulls=True).over(inside)).where("_side = 1")
    lasts = rows.groupBy(key, "_period").agg(F.max(F.when(F.col("_side") == 0, F.struct("ts", "_tie", "_value"))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_before", F.last("_last._value", ignorenulls=True).over(before)).select(key, "_period", "_before")
    return filled.join(carried, [key, "_period"]).select("_left.*", F.coalesce(name, "_before").alias(name))


def asof_origin(queries: DataFrame, fixes: DataFrame, key: str = "user_id", unit: str = "day") -> DataFrame:
    """``queries`` (key, ts, …) with ``origin``, the latest fix (key, ts, fix_id, value) at or before each; null if none."""
    fix = F.struct(F.col("fix_id").cast("bigint").alias("fix_id"), F.col("value").cast("double").alias("value"))
    return _asof(queries, fixes.select(key, "ts", "fix_id", fix.alias("_fix")), "_fix", "fix_id", key, unit, "origin")


def reruns(changes: DataFrame, queries: DataFrame, key: str = "user_id", unit: str = "day") -> DataFrame:
    """Each change of an origin (key, ts, …) with ``query``, the user's query (key, ts, query_id, text) that is searched again; none without one."""
    asked = F.struct(F.col("query_id").cast("bigint").alias("query_id"), "text")
    found = _asof(changes, queries.select(key, "ts", "query_id", asked.alias("_asked")), "_asked", "query_id", key, unit, "query")
    return found.where(F.trim(F.col("query.text")) != "")


def origin_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last origin event (ts, event_id, kind, lat, lon, label) of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct("ts", "kind", "lat", "lon", "label"), F.struct("ts", "event_id")).alias("origin")).select(key, "origin.*")


def debounced(events: DataFrame, gap: str, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), unit: str = "day") -> DataFrame:
    """The events that no other event of the key follows within ``gap``."""
    rows = events.withColumn("_period", _period(unit=unit))
    following = F.lead("ts").over(Window.partitionBy(key, "_period").orderBy(*order))
    firsts = rows.groupBy(key, "_period").agg(F.min("ts").alias("_first"))
    later = firsts.withColumn("_later", F.lead("_first").over(Window.partitionBy(key).orderBy("_period"))).drop("_first")
    joined = rows.withColumn("_next", following).join(later, [key, "_period"]).withColumn("_next", F.coalesce("_next", "_later"))
    kept = joined.where(F.col("_next").isNull() | (F.col("_next") >= F.col("ts") + F.expr(f"interval {gap}")))
    return kept.select(*events.columns)


def latest_wins(answers: DataFrame, key: str = "user_id", request: str = "request_id") -> DataFrame:
    """Only the answer to the newest request of each key."""
    newest = answers.groupBy(key).agg(F.max_by(F.struct(*[c for c in answers.columns if c != key]), request).alias("a"))
    return newest.select(key, "a.*")


def throttled(fixes: DataFrame, period: str, key: str = "user_id") -> DataFrame:
    """The last fix of each key in each tumbling window of ``period``."""
    grouped = fixes.groupBy(key, F.window("ts", period).alias("w")).agg(F.max_by(F.struct("fix_id", "ts", "value"), F.struct("ts", "fix_id")).alias("f"))
    return grouped.select(key, F.col("w.start").alias("window_start"), "f.fix_id", "f.ts", "f.value")


def moved(fixes: DataFrame, least_m: float, key: str = "user_id", unit: str = "day") -> DataFrame:
    """Fixes at least ``least_m`` metres from the one before."""
    from waymark.functions.geo import equirectangular_m

    rows = fixes.withColumn("_period", _period(unit=unit))
    order, spot = Window.partitionBy(key, "_period").orderBy("ts", "fix_id"), F.struct("lat", "lon")
    lasts = rows.groupBy(key, "_period").agg(F.max_by(spot, F.struct("ts", "fix_id")).alias("_last"))
    carried = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_period"))).drop("_last")
    joined = rows.withColumn("_before", F.lag(spot).over(order)).join(carried, [key, "_period"]).withColumn("_before", F.coalesce("_before", "_carried"))
    far = equirectangular_m(F.col("_before.lat"), F.col("_before.lon"), F.col("lat"), F.col("lon"))
    return joined.withColumn("_m", far).where(F.col("_m").isNull() | (F.col("_m") >= least_m)).select(*fixes.columns)


def fresh(entries: DataFrame, now, ttl: str = "7 days") -> DataFrame:
    """Cache entries that are not older than ``ttl``."""
    return entries.where(F.col("ts") >= now - F.expr(f"interval {ttl}"))
