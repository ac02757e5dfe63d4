"""From tagged map objects to places, their names, and the sources of spatial context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import line_centroid, polygons_centroid
from waymark.functions.text import casefold, clean, romanisations
from waymark.schema import ADMIN_LEVELS, NAME_KEYS, NEARBY_RANKS, STRONG_KEYS, WEAK_KEYS


def tag(tags: Column, key: str) -> Column:
    """The value of a key in an array of (k, v), or null."""
    return F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"]


def named(objects: DataFrame) -> DataFrame:
    """Objects with a non-empty cleaned name, as ``name``."""
    return objects.withColumn("name", clean(tag(F.col("tags"), "name"))).where("name <> ''")


def category(tags: Column) -> Column:
    """``key=value`` of the first strong key present, else of the first weak one, else null."""
    return F.coalesce(*(F.concat(F.lit(f"{k}="), tag(tags, k)) for k in (*STRONG_KEYS, *WEAK_KEYS)))


def roles(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Administrative areas, settlements and streets among named objects."""
    tags = F.col("tags")
    boundary = (F.col("osm_type") == "a") & (tag(tags, "boundary") == "administrative")
    admin = objects.where(boundary & tag(tags, "admin_level").isin(*ADMIN_LEVELS)).withColumn("level", tag(tags, "admin_level"))
    places = objects.where((F.col("osm_type") == "n") & tag(tags, "place").isin(*NEARBY_RANKS)).withColumn("rank", tag(tags, "place"))
    streets = objects.where((F.col("osm_type") == "w") & tag(tags, "highway").isNotNull())
    return (
        admin.where(F.size("polys") > 0).select("seq", "name", "level", "polys"),
        places.select("seq", "name", "rank", "lon", "lat"),
        streets.where(F.size("line") > 0).select("seq", "name", "line"),
    )


def bounds(points: Column) -> Column:
    """The box of an array of points."""
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("x0"), F.array_min(lats).alias("y0"), F.array_max(lons).alias("x1"), F.array_max(lats).alias("y1")
    )


def near_box(sources: DataFrame, points: Column, box: tuple[float, float, float, float], pad: float) -> DataFrame:
    """Context sources whose box meets the padded one."""
    b = bounds(points)
    return sources.where((b["x1"] >= box[0] - pad) & (b["x0"] <= box[2] + pad) & (b["y1"] >= box[1] - pad) & (b["y0"] <= box[3] + pad))


def in_box(places: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Places inside a box, its edge included."""
    if box is None:
        return places
    return places.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def located(objects: DataFrame) -> DataFrame:
    """Objects with their representative point: a node's place, else the centroid; empty geometries go."""
    point = F.when(F.col("osm_type") == "n", F.struct("lon", "lat")).otherwise(
        F.coalesce(F.when(F.size("polys") > 0, polygons_centroid(F.col("polys"))), F.when(F.size("line") > 0, line_centroid(F.col("line"))))
    )
    # Exploded, so that each column and the filter do not find it anew.
    return objects.withColumn("_at", F.explode_outer(F.array(point))).withColumns({"lon": F.col("_at.lon"), "lat": F.col("_at.lat")}).drop("_at").where("lon is not null and lat is not null")


def name_variants(objects: DataFrame, key: str = "place_id") -> DataFrame:
    """(key, ord, source, name): tagged names in order, then their romanisations; the first of equal folded names stays."""
    tags = F.col("tags")
    shown = lambda t: F.struct(t["k"].alias("source"), clean(t["v"]).alias("name"))
    exact = F.array(*(F.struct(F.lit(k).alias("source"), clean(tag(tags, k)).alias("name")) for k in NAME_KEYS))
    prefixed = F.transform(F.filter(tags, lambda t: t["k"].startswith("name:") | t["k"].startswith("alt_name:")), shown)
    listed = objects.select(key, F.posexplode(F.concat(exact, prefixed)).alias("ord", "v")).select(key, "ord", "v.source", "v.name").where("name <> ''")
    return _first_names(_with_romanisations(_first_names(listed, key)), key)


def _with_romanisations(names: DataFrame) -> DataFrame:
    more = names.select(*names.columns[:-2], F.posexplode(romanisations(F.col("name"))).alias("_k", "r"))
    kept = names.select("*", F.lit(-1).alias("_k"), F.lit(0).alias("_late"))
    return kept.unionByName(more.select(*names.columns[:-2], F.col("r.scheme").alias("source"), clean(F.col("r.value")).alias("name"), "_k", F.lit(1).alias("_late")))


def _first_names(names: DataFrame, key: str) -> DataFrame:
    """The first row of each folded name of a place, renumbered in order (a place has few names)."""
    order = [c for c in ("_late", "ord", "_k") if c in names.columns]
    firsts = names.withColumn("_folded", casefold(F.col("name"))).groupBy(key, "_folded").agg(F.min_by(F.struct("source", "name"), F.struct(*order)).alias("v"), F.min(F.struct(*order)).alias("o"))
    gathered = firsts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "v"))).alias("all"))
    return gathered.select(key, F.posexplode("all").alias("ord", "x")).select(key, "ord", "x.v.source", "x.v.name")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
