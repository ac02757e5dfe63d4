"""OpenStreetMap extracts as tagged objects with geometry: XML files, and the assembly of lines and areas.

``nodes`` (id, lon, lat, tags), ``ways`` (id, refs, tags) and ``relations`` (id, members, tags) come from a
reader; :func:`objects` joins them into the engine's objects.  Order is by kind and id, which ``seq`` keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.rings import polygons
from waymark.schema import POINT

TAGS = "array<struct<_k: string, _v: string>>"
NODE = f"_id bigint, _lat double, _lon double, tag {TAGS}"
WAY = f"_id bigint, nd array<struct<_ref: bigint>>, tag {TAGS}"
RELATION = f"_id bigint, member array<struct<_type: string, _ref: bigint, _role: string>>, tag {TAGS}"


def _tags():
    return F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k: string, v: string>>"))


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of .osm XML files."""
    rows = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = rows("node", NODE).select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags().alias("tags"))
    ways = rows("way", WAY).select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _tags().alias("tags"))
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    relations = rows("relation", RELATION).select(F.col("_id").alias("id"), members.alias("members"), _tags().alias("tags"))
    return nodes, ways, relations


def read_once(spark: SparkSession, path: str, folder: str, key: str | None = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of an extract, decoded once and kept as Parquet; later passes read columns of that.

    Of a .pbf extract, only objects with a tag ``key`` keep their tags (all, if None): the others matter as points and lines alone.
    """
    if path.endswith(".pbf"):
        from waymark.sources.pbf import read_rows

        read_rows(spark, path, key=key).write.mode("overwrite").partitionBy("kind").parquet(folder)
        kept = spark.read.schema("id bigint, lon double, lat double, tags array<struct<k: string, v: string>>, refs array<bigint>, members array<struct<type: string, ref: bigint, role: string>>, kind string").parquet(folder)
        of = lambda kind, *columns: kept.where(F.col("kind") == kind).select("id", *columns, "tags")
        return of("node", "lon", "lat"), of("way", "refs"), of("relation", "members")
    for name, df in zip(("node", "way", "relation"), read_xml(spark, path), strict=True):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("node", "way", "relation"))


def has_tag(key: str, value: str | None = None):
    return F.exists("tags", lambda t: (t["k"] == key) & (F.lit(True) if value is None else t["v"] == value))


def lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, refs, line): the points of each way in order; nodes that the extract lacks are left out."""
    spots = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    found = spots.join(nodes.select(F.col("id").alias("ref"), F.struct("lon", "lat").alias("p")), "ref")
    ordered = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "p"))).alias("n"))
    return ordered.select("id", F.transform("n", lambda n: n["ref"]).alias("refs"), F.transform("n", lambda n: n["p"]).alias("line"))


def areas(relations: DataFrame, drawn: DataFrame) -> DataFrame:
    """(id, polys) of multipolygon and boundary relations: each outer ring with the holes in it (see ``functions.rings``).

    Geometry decides what is a hole, not the members' roles.  A relation is one row in the end, so its lines meet in one task.
    """
    wanted = relations.where(has_tag("type", "multipolygon") | has_tag("type", "boundary"))
    members = wanted.select("id", F.explode("members").alias("m")).where("m.type = 'way'").select("id", F.col("m.ref").alias("way")).distinct()
    # Plain arrays of numbers reach Python as such.
    numbers = lambda name: F.transform("line", lambda p: p[name]).alias(name)
    parts = members.join(drawn.select(F.col("id").alias("way"), numbers("lon"), numbers("lat")), "way").select("id", "lon", "lat")
    shape = T.ArrayType(T.ArrayType(T.ArrayType(T._parse_datatype_string(POINT))))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("polys", shape)])

    def assemble(group: pd.DataFrame) -> pd.DataFrame:
        lines = [np.column_stack([x, y]) for x, y in zip(group["lon"], group["lat"], strict=True)]
        as_rows = [[[{"lon": p.real, "lat": p.imag} for p in ring.tolist()] for ring in poly] for poly in polygons(lines)]
        return pd.DataFrame({"id": [group["id"].iloc[0]], "polys": [as_rows]})

    return parts.groupBy("id").applyInPandas(assemble, schema)


def objects(nodes: DataFrame, ways: DataFrame, relations: DataFrame, key: str | None = "name") -> DataFrame:
    """The engine's objects (see ``schema.OSM_OBJECT``); only those with a tag ``key``, which is tested before any join.

    A closed way is both a way and an area, unless tagged ``area=no``; area ids are twice the way's id, or
    twice the relation's id plus one.
    """
    keep = (lambda df: df.where(has_tag(key))) if key else (lambda df: df)
    none_line, none_polys = F.lit(None).cast(f"array<{POINT}>"), F.lit(None).cast(f"array<array<array<{POINT}>>>")
    nowhere = (F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    seq = lambda rank: (F.lit(rank).cast("bigint") * F.lit(1 << 60) + F.col("osm_id")).alias("seq")
    shaped = lambda df, kind, rank: df.select(F.lit(kind).alias("osm_type"), "osm_id", seq(rank), "tags", "lon", "lat", "line", "polys")
    points = keep(nodes).select(F.col("id").alias("osm_id"), "tags", "lon", "lat", none_line.alias("line"), none_polys.alias("polys"))
    # Ways are drawn once: those kept for themselves and those that a kept relation needs.
    kept_relations = keep(relations)
    needed = kept_relations.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("id")).distinct()
    used = keep(ways).select("id").unionByName(needed).distinct()
    drawn = lines(ways.join(used, "id", "left_semi"), nodes)
    named = keep(ways).select("id", "tags").join(drawn, "id")
    as_lines = named.select(F.col("id").alias("osm_id"), "tags", *nowhere, "line", none_polys.alias("polys"))
    closed = named.where((F.get("refs", F.lit(0)) == F.element_at("refs", -1)) & (F.size("refs") > 3) & ~has_tag("area", "no"))
    as_areas = closed.select((F.col("id") * 2).alias("osm_id"), "tags", *nowhere, none_line.alias("line"), F.array(F.array("line")).alias("polys"))
    built = kept_relations.join(areas(kept_relations, drawn), "id").where(F.size("polys") > 0)
    as_areas = as_areas.unionByName(built.select((F.col("id") * 2 + 1).alias("osm_id"), "tags", *nowhere, none_line.alias("line"), "polys"))
    return shaped(points, "n", 0).unionByName(shaped(as_lines, "w", 1)).unionByName(shaped(as_areas, "a", 2))


def write_xml_nodes(exported: DataFrame, folder: str) -> None:
    """Exported nodes (node_id, lon, lat, name, and key and value or an array ``tags``) as .osm XML."""
    tag = lambda k, v: F.struct(k.alias("_k"), v.alias("_v"))
    own = F.transform("tags", lambda t: tag(t["k"], t["v"])) if "tags" in exported.columns else F.array(tag(F.col("key"), F.col("value")))
    tags = F.concat(F.array(tag(F.lit("name"), F.col("name"))), own)
    rows = exported.select(F.col("node_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), tags.alias("tag"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "osm").option("rowTag", "node").save(folder)


def stored(spark: SparkSession, folder: str, build, refresh: bool = False) -> tuple[DataFrame, ...]:
    """The tables that ``build()`` returns by name, from ``folder`` if they were written there before."""
    from pyspark.errors import AnalysisException

    def opened() -> Iterator[DataFrame]:
        for name in ("areas", "settlements", "streets"):
            yield spark.read.parquet(f"{folder}/{name}")

    if not refresh:
        try:
            return tuple(opened())
        except AnalysisException:
            pass
    for name, df in zip(("areas", "settlements", "streets"), build(), strict=True):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return tuple(opened())
