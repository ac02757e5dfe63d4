"""Command line: build an index from an extract and search it; probe, stage and audit nodes for an external map tool."""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from waymark.functions.present import hit_line
from waymark.functions.text import clean
from waymark.operators import context, export, index, ingest, search
from waymark.schema import QUERY, ContextParams
from waymark.sources import osm


def build(spark: SparkSession, extract: str, out: str, box: tuple[float, float, float, float] | None = None, refresh: bool = False, params: ContextParams = ContextParams()) -> tuple[int, int]:
    """Enrich every named place of an extract and write places, names, nodes and the index; returns the counts of places and names."""

    counts: dict[str, Observation] = {}

    def kept(df, name: str):
        # Rows are counted as they are written: nothing is read again for a number.
        counts[name] = Observation(name)
        df.observe(counts[name], F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    objects = kept(ingest.named(osm.objects(*osm.read_once(spark, extract, f"{out}/extract"))), "objects")

    def sources():
        admin, settled, streets = ingest.roles(objects)
        if box is None:
            return admin, settled, streets
        near = lambda df, points: ingest.near_box(df, points, box, params.pad_degrees)
        return near(admin, F.flatten(F.flatten("polys"))), near(settled, F.array(F.struct("lon", "lat"))), near(streets, F.col("line"))

    admin, settled, streets = osm.stored(spark, f"{out}/context", sources, refresh)
    placed = objects.withColumn("category", ingest.category(F.col("tags"))).where("category is not null")
    placed = ingest.in_box(ingest.located(placed), box).withColumn("addr_street", clean(ingest.tag(F.col("tags"), "addr:street")))
    # Dense ids keep the postings' deltas small.
    saved = kept(export.number_rows(placed.drop("line", "polys"), ["seq"], "place_id"), "placed")
    names = kept(ingest.name_variants(saved), "names")
    around = context.context(saved.select("place_id", "name", "lon", "lat", "addr_street"), admin, settled, streets, params)
    places = kept(saved.drop("addr_street").join(around.select("place_id", F.array_join("context", ", ").alias("context")), "place_id"), "places")
    osm.write_xml_nodes(kept(export.export_nodes(places, names), "nodes"), f"{out}/nodes.osm")
    index.write_index(index.terms(places, names), f"{out}/index")
    return counts["places"].get["n"], counts["names"].get["n"]


def probe(spark: SparkSession, out: str) -> int:
    """Write one node for each category, for the external map tool to accept or reject; returns their count."""
    nodes = export.probes(spark.read.parquet(f"{out}/places"))
    osm.write_xml_nodes(nodes, f"{out}/probes.osm")
    return nodes.count()


def stage(spark: SparkSession, out: str, inspected: str) -> tuple[int, int]:
    """Write the nodes as the tool keeps them, given what its inspector printed of the probes; returns (total, rescued)."""
    surviving = export.ids_in_text(spark.read.text(inspected))
    nodes, counts = export.staged(spark.read.parquet(f"{out}/nodes"), spark.read.parquet(f"{out}/places"), surviving)
    osm.write_xml_nodes(nodes, f"{out}/staged.osm")
    return tuple(counts.first())


def audit(spark: SparkSession, out: str, inspected: str) -> int:
    """How many nodes the finished map holds, by what the inspector printed of it; raises if any is lost."""
    return export.check_audit(export.audit(spark.read.parquet(f"{out}/nodes"), export.ids_in_text(spark.read.text(inspected))))


def find(spark: SparkSession, folder: str, text: str, limit: int = 20, near: tuple[float, float] | None = None):
    """Hits of one query as a DataFrame, in order."""
    lat, lon = near or (None, None)
    asked = spark.createDataFrame([(1, text, limit, 0.6, lat, lon)], QUERY)
    return search.search(index.Index.open(spark, f"{folder}/index"), asked).orderBy("pos")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="waymark")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build")
    b.add_argument("extract")
    b.add_argument("out")
    b.add_argument("--box", type=float, nargs=4)
    b.add_argument("--refresh", action="store_true")
    s = commands.add_parser("search")
    s.add_argument("folder")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--near", type=float, nargs=2)
    commands.add_parser("probe").add_argument("out")
    for name in ("stage", "audit"):
        c = commands.add_parser(name)
        c.add_argument("out")
        c.add_argument("inspected")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("waymark").getOrCreate()
    if args.command == "build":
        print("%d places, %d names" % build(spark, args.extract, args.out, args.box and tuple(args.box), args.refresh))
    elif args.command == "probe":
        print("%d categories" % probe(spark, args.out))
    elif args.command == "stage":
        print("%d nodes, %d rescued" % stage(spark, args.out, args.inspected))
    elif args.command == "audit":
        print("%d nodes kept, none lost" % audit(spark, args.out, args.inspected))
    else:
        c = F.col
        line = hit_line(c("score"), c("exact_count"), c("name"), c("address"), c("lat"), c("lon"), c("metres"))
        for row in find(spark, args.folder, args.query, args.limit, args.near and tuple(args.near)).select(line.alias("line")).toLocalIterator():
            print(row["line"])


if __name__ == "__main__":
    main()
