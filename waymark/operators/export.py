"""Exports: one node per name variant, categories an external tool rejects, and the audit of what it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.present import display_name, matched_context, split_category
from waymark.lineage import settle

RESCUE_KEY, RESCUE_VALUE = "place", "locality"


def export_nodes(places: DataFrame, names: DataFrame) -> DataFrame:
    """(node_id, place_id, lon, lat, name, key, value): ids run from 1 by (place_id, ord)."""
    key, value = split_category(F.col("category"))
    joined = places.join(names.select("place_id", "ord", F.col("name").alias("variant")), "place_id")
    shown = display_name(F.col("variant"), matched_context(F.col("variant"), F.col("context")))
    rows = joined.select("place_id", "ord", "lon", "lat", shown.alias("name"), key.alias("key"), value.alias("value"))
    return number_rows(rows, ["place_id", "ord"], "node_id").drop("ord")


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 by ``order`` without bringing all rows together.

    Rows are ranged and sorted, which a checkpoint fixes; only the sizes of the ranges are added up in order.
    """
    place = F.monotonically_increasing_id()  # the partition, and 33 bits for the row in it
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", place)
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + inside).drop("_part", "_at", "_start")


def distinct_categories(places: DataFrame) -> DataFrame:
    """(probe_id, category): the distinct categories, numbered in order (there are few of them)."""
    order = Window.orderBy("category")
    return places.select("category").where("category is not null").distinct().withColumn("probe_id", F.row_number().over(order))


def accepted(probes: DataFrame, surviving: DataFrame) -> DataFrame:
    """The categories whose probe survived; ``surviving`` has (probe_id)."""
    return probes.join(surviving.select("probe_id").distinct(), "probe_id", "left_semi").select("category")


def first_tag(tags: Column) -> Column:
    """The first tag of a node that is not its name."""
    return F.get(F.filter(tags, lambda t: t["k"] != "name"), F.lit(0))


def rescue(nodes: DataFrame, accepted_categories: DataFrame) -> DataFrame:
    """``nodes`` (key, value, …) with ``tags``; a rejected category gets the rescue tag, over any place tag."""
    ok = accepted_categories.select(F.col("category").alias("_ok")).distinct()
    joined = nodes.join(ok, F.concat("key", F.lit("="), "value") == F.col("_ok"), "left")
    own, saved = F.struct(F.col("key").alias("k"), F.col("value").alias("v")), F.struct(F.lit(RESCUE_KEY).alias("k"), F.lit(RESCUE_VALUE).alias("v"))
    tags = F.when(F.col("_ok").isNotNull(), F.array(own)).when(F.col("key") == RESCUE_KEY, F.array(saved)).otherwise(F.array(own, saved))
    return joined.withColumn("tags", tags).withColumn("rescued", F.col("_ok").isNull()).drop("_ok")


def audit(written: DataFrame, read_back: DataFrame, key: str = "node_id") -> DataFrame:
    """(written, kept, lost): rows written and distinct ids read back."""
    ids = written.select(F.lit(1).alias("written"), F.lit(None).alias(key)).unionByName(read_back.select(F.lit(0).alias("written"), key))
    return ids.agg(F.sum("written").alias("written"), F.count_distinct(key).alias("kept")).withColumn("lost", F.col("written") - F.col("kept"))


def probes(places: DataFrame) -> DataFrame:
    """One node for each distinct category, for an external tool to accept or reject: (node_id, lon, lat, name, key, value)."""
    key, value = split_category(F.col("category"))
    return distinct_categories(places).select(F.col("probe_id").alias("node_id"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), F.col("category").alias("name"), key.alias("key"), value.alias("value"))


def staged(nodes: DataFrame, places: DataFrame, surviving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with the tags that the tool keeps, and how many there are: (total, rescued); ``surviving`` has (node_id) of probes."""
    named = distinct_categories(places)
    saved = rescue(nodes, accepted(named, surviving.select(F.col("node_id").alias("probe_id"))))
    return saved, saved.agg(F.count("*").alias("total"), F.count_if("rescued").alias("rescued"))


def check_audit(audited: DataFrame) -> int:
    """The kept count; raises if anything was lost."""
    row = audited.first()
    if row["lost"] > 0:
        raise ValueError(f"{row['lost']} of {row['written']} nodes were lost")
    return row["kept"]


def ids_in_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """(node_id): the distinct ids that an inspector's output names."""
    found = lines.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"osmid=(\d+)"), F.lit(1))).alias("id"))
    return found.select(F.col("id").cast("bigint").alias("node_id")).distinct()
