"""The spatial context of places, put together from all joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.spatial import areas_of, nearby_settlements, nearest_street, nearest_subdivision
from waymark.schema import ADMIN_LEVELS, ContextParams


def assemble(parts: DataFrame, places: DataFrame, params: ContextParams = ContextParams()) -> DataFrame:
    """(place_id, context array): names by (kind, pos), without the place's own name and repeats, capped.

    ``parts`` has (place_id, kind int, pos int, name); ``places`` (place_id, name).
    """
    grouped = parts.groupBy("place_id").agg(F.sort_array(F.collect_list(F.struct("kind", "pos", "name"))).alias("parts"))
    joined = places.join(grouped, "place_id", "left")
    names = F.transform(F.coalesce("parts", F.expr("array()").cast("array<struct<kind: int, pos: int, name: string>>")), lambda p: p["name"])
    kept = F.filter(names, lambda n: n.isNotNull() & (n != "") & (n != F.col("name")))
    return joined.select("place_id", F.slice(F.array_distinct(kept), 1, params.parts).alias("context"))


def context(places: DataFrame, areas: DataFrame, settlements: DataFrame, streets: DataFrame, params: ContextParams = ContextParams()) -> DataFrame:
    """(place_id, context) of ``places`` (place_id, name, lon, lat, addr_street): settlements, street, subdivision, areas."""
    kind = lambda df, k: df.select("place_id", F.lit(k).alias("kind"), F.col("pos").cast("int").alias("pos"), "name")
    level = F.array_position(F.array(*map(F.lit, ADMIN_LEVELS)), F.col("level")).alias("pos")
    unaddressed = places.where(F.coalesce("addr_street", F.lit("")) == "")
    street = nearest_street(unaddressed, streets, params.street_radius).select("place_id", F.lit(1).alias("pos"), "name")
    addressed = places.where("addr_street <> ''").select("place_id", F.lit(1).alias("pos"), F.col("addr_street").alias("name"))
    parts = (
        kind(nearby_settlements(places, settlements, params), 0)
        .unionByName(kind(street.unionByName(addressed), 1))
        .unionByName(kind(nearest_subdivision(places, settlements, params), 2))
        .unionByName(kind(areas_of(places, areas).select("place_id", level, "name"), 3))
    )
    return assemble(parts, places, params)
