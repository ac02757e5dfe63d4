"""The engine's inputs from the driver's tables: places, map objects, settlements, areas, streets, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import clean, normalise, word_set
from waymark.operators.index import terms
from waymark.schema import NEARBY_RANKS

LATIN, CYRILLIC = "abvgdeziklmnoprstufy", "абвгдезіклмнопрстуфй"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point(key: str) -> tuple[Column, Column]:
    """Longitude and latitude spread by a key over a box of 3.8 by 2.1 degrees."""
    lon = F.lit(22.5) + ((F.col(key) * 7919) % 38000) / F.lit(10000.0)
    return lon, F.lit(48.6) + ((F.col(key) * 104729) % 21000) / F.lit(10000.0)


def _document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as places, their texts as they are."""
    docs = read(spark, sf_dir, "documents").repartition("doc_id")  # one file is one task, and words are dear
    at = F.instr("text", ".")
    name = F.substring_index("text", ".", 1)
    rest = F.when(at > 0, F.substring(F.col("text"), at + 1, F.length("text"))).otherwise("")
    kind = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("place="), "lang")).otherwise(F.concat(F.lit("shop="), "source"))
    lon, lat = point("doc_id")
    return docs.select(F.col("doc_id").alias("place_id"), name.alias("name"), rest.alias("context"), kind.alias("category"), lon.alias("lon"), lat.alias("lat"))


def document_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as places: the text up to the first full stop is the name, the rest the context."""
    return _cleaned(_document_parts(spark, sf_dir))


def _cleaned(places: DataFrame) -> DataFrame:
    return places.withColumns({c: clean(F.col(c)) for c in ("name", "context")})


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning moves no word, so texts are cleaned after their words are found, and only where they are asked for."""
    return _cleaned(terms(_document_parts(spark, sf_dir)))


def search_queries(spark: SparkSession, sf_dir: str, lim: int = 20) -> DataFrame:
    """One query for each benchmark item: its three longest words, the first misspelled for odd items."""
    items = read(spark, sf_dir, "benchmark")
    long_first = F.array_sort(F.transform(word_set(normalise(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    own = items.select("item_id", F.transform(F.slice(long_first, 1, 3), lambda x: x["w"]).alias("w"))
    first = F.get("w", F.lit(0))
    wrong = F.concat(F.substring(first, F.lit(1), F.length(first) - 2), F.lit("x"), F.substring(first, F.length(first), F.lit(1)))
    text = F.concat_ws(" ", F.when(F.col("item_id") % 2 == 1, wrong).otherwise(first), F.get("w", F.lit(1)), F.get("w", F.lit(2)))
    near = F.col("item_id") % 3 == 0
    return own.select(
        F.col("item_id").alias("query_id"), text.alias("text"), F.lit(lim).alias("lim"), F.lit(0.6).alias("threshold"),
        F.when(near, 49.5).alias("lat"), F.when(near, 24.0).alias("lon"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tagged map objects with a point, a line and a square each."""
    rows = read(spark, sf_dir, "customer").repartition("c_custkey")  # one file is one task, and shapes are dear
    key, (lon, lat) = F.col("c_custkey"), point("c_custkey")
    tag = lambda k, v, when: F.when(when, F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")))
    ranks = F.array(*map(F.lit, NEARBY_RANKS))
    tags = F.array_compact(F.array(
        tag("name", F.col("c_name"), F.lit(True)), tag("building", F.lit("yes"), key % 3 == 0), tag("shop", F.lower("c_mktsegment"), key % 2 == 0),
        tag("amenity", F.lit("cafe"), key % 5 == 0), tag("boundary", F.lit("administrative"), key % 7 == 0), tag("admin_level", 4 + key % 5, key % 7 == 0),
        tag("place", F.get(ranks, (key % 10).cast("int")), key % 11 == 0), tag("highway", F.lit("residential"), key % 13 == 0),
    ))
    p = lambda dx, dy: F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    square = F.array(p(0.0, 0.0), p(0.01, 0.0), p(0.01, 0.01), p(0.0, 0.01), p(0.0, 0.0))
    kind = F.get(F.array(F.lit("n"), F.lit("w"), F.lit("a")), (key % 3).cast("int"))
    return rows.select(kind.alias("osm_type"), key.alias("osm_id"), key.alias("seq"), tags.alias("tags"), lon.alias("lon"), lat.alias("lat")).withColumns(
        {"line": F.array(p(0.0, 0.0), p(0.01, 0.005)), "polys": F.array(F.array(square))}
    )


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = point("c_custkey")
    street = F.when(F.col("c_custkey") % 20 == 0, F.concat(F.lit("addr "), "c_mktsegment")).otherwise("")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), lon.alias("lon"), lat.alias("lat"), street.alias("addr_street"))


def supplier_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = point("s_suppkey")
    rank = F.get(F.array(*map(F.lit, NEARBY_RANKS)), (F.col("s_suppkey") % 10).cast("int"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), rank.alias("rank"), lon.alias("lon"), lat.alias("lat"))


def _rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))))


def nation_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a five by five grid of level 8, regions as five strips of level 4."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    x = F.lit(22.5) + (F.col("n_nationkey") % 5) * F.lit(0.76)
    y = F.lit(48.6) + F.floor(F.col("n_nationkey") / 5) * F.lit(0.42)
    fine = nation.select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_name").alias("name"), F.lit("8").alias("level"), _rectangle(x, y, x + F.lit(0.76), y + F.lit(0.42)).alias("polys"))
    x = F.lit(22.5) + F.col("r_regionkey") * F.lit(0.76)
    coarse = region.select(F.col("r_regionkey").cast("bigint").alias("seq"), F.col("r_name").alias("name"), F.lit("4").alias("level"), _rectangle(x, F.lit(48.6), x + F.lit(0.76), F.lit(50.7)).alias("polys"))
    return fine.unionByName(coarse)


def nation_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each cell of the nations' grid a triangle (two slanted edges), of level 8, with a smaller one cut out of it; points count from the cell's corner."""
    nation = read(spark, sf_dir, "nation")
    x = F.lit(22.5) + (F.col("n_nationkey") % 5) * F.lit(0.76)
    y = F.lit(48.6) + F.floor(F.col("n_nationkey") / 5) * F.lit(0.42)
    p = lambda dx, dy: F.struct(F.lit(dx).alias("lon"), F.lit(dy).alias("lat"))
    outer = F.array(p(0.0, 0.0), p(0.76, 0.0), p(0.38, 0.4), p(0.0, 0.0))
    hole = F.array(p(0.3, 0.1), p(0.46, 0.1), p(0.38, 0.2), p(0.3, 0.1))
    return nation.select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_name").alias("name"), F.lit("8").alias("level"), F.array(F.array(outer, hole)).alias("polys"), F.struct(x.alias("lon"), y.alias("lat")).alias("origin"))


def part_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = point("_k")
    rows = read(spark, sf_dir, "part").withColumn("_k", F.col("p_partkey") + 50021)
    a = F.struct(lon.alias("lon"), lat.alias("lat"))
    b = F.struct((lon + ((F.col("p_partkey") % 11) - 5) / F.lit(50.0)).alias("lon"), (lat + ((F.col("p_partkey") % 7) - 3) / F.lit(50.0)).alias("lat"))
    return rows.select(F.col("p_partkey").alias("seq"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), F.array(a, b).alias("line"))


def part_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a name in several spellings, one of them Cyrillic."""
    tag = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("place_id"),
        F.array(tag("name:uk", cyrillic("p_name")), tag("name", F.col("p_name")), tag("alt_name", F.upper("p_name")), tag("old_name", F.col("p_brand"))).alias("tags"),
    )


def cyrillic(column: str) -> Column:
    return F.translate(F.lower(F.col(column)), LATIN, CYRILLIC)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their instants as session-zone timestamps."""
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
