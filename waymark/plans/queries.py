"""The driver's queries: each applies one operator of the engine to the driver's tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import present
from waymark.functions.geo import equirectangular_m
from waymark.functions.similarity import score_pairs, block_ratio
from waymark.functions.text import clean, is_cyrillic, normalise, romanise_kmu, romanise_naive, words
from waymark.lineage import settle, shared_folder
from waymark.operators import codec, context, export, index, ingest, origin, search, spatial
from waymark.schema import ADMIN_LEVELS, ContextParams
from waymark.sources import adapters as src
from waymark.sources.adapters import read

BOX = (23.0, 49.0, 24.5, 50.0)
WIDE = ContextParams(settlement_radius=60_000.0)


def joined(column) -> "F.Column":
    return F.array_join(column, ",")


def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", normalise(F.col("text")).alias("folded"))


def tokenise_words(spark, d):
    rows = read(spark, d, "documents").select("doc_id", words(normalise(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.array_join("w", " ").alias("words"))


def clean_whitespace(spark, d):
    return read(spark, d, "pages").select("page_id", clean(F.col("html")).alias("cleaned"))


def category_pick(spark, d):
    rows = ingest.named(src.objects(spark, d)).withColumn("category", ingest.category(F.col("tags"))).where("category is not null")
    key, value = present.split_category(F.col("category"))
    return rows.select("osm_id", "category", key.alias("k"), value.alias("v"))


def role_split(spark, d):
    named = ingest.named(src.objects(spark, d))
    parts = zip(("admin", "settlement", "street"), ingest.roles(named), ("level", "rank", "name"), strict=True)
    return ingest.union_all([df.select("seq", F.lit(role).alias("role"), F.col(kind).alias("kind")) for role, df, kind in parts])


def bbox_filter(spark, d):
    return ingest.in_box(src.customer_places(spark, d), BOX).select("place_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def padded_sources(spark, d):
    kept = ingest.near_box(src.part_streets(spark, d), F.col("line"), BOX, ContextParams().pad_degrees)
    return kept.select("seq", "name")


def name_concat(spark, d):
    """The spellings of each part's name as one text: few names for each place."""
    names = ingest.name_variants(src.part_objects(spark, d))
    grouped = names.groupBy("place_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda n: n["name"]), "\n").alias("names"))
    return read(spark, d, "part").join(grouped, F.col("p_partkey") == F.col("place_id")).select("p_partkey", "p_name", "names")


def name_variants_dedup(spark, d):
    return ingest.name_variants(src.part_objects(spark, d)).select("place_id", F.col("ord").cast("int").alias("ord"), "source", "name")


def context_except(spark, d):
    t = src.document_terms(spark, d)
    return t.select("place_id", F.array_join("name_terms", " ").alias("name_terms"), F.array_join("context_terms", " ").alias("context_terms"))


def _pairs(spark, d):
    return index.pairs(src.document_terms(spark, d))


def postings_build(spark, d):
    return index.postings(_pairs(spark, d)).select("word", "range", "places", joined(F.col("postings").cast("array<string>")).alias("postings"))


def postings_codec(spark, d):
    """Every word's postings as bytes, and what these decode to."""
    back = codec.decode(codec.streams(codec.encode(_pairs(spark, d))), "places", "first", "data")
    return back.select("word", "range", "places", F.col("first").alias("first_ref"), F.lower(F.hex("data")).alias("data"), F.octet_length("data").cast("bigint").alias("n_bytes"), joined(F.col("postings").cast("array<string>")).alias("postings"))


def postings_bytes(spark, d):
    return index.vocabulary(_pairs(spark, d)).select("word", F.col("n_chars").cast("bigint").alias("n_chars"), "places", "blob_bytes")


def postings_roundtrip(spark, d):
    return index.unpack_postings(index.postings(_pairs(spark, d)))


_BUILT: dict[tuple[str, str], str] = {}


def _index(spark, d):
    """The stored index over all documents, built once a session and input."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        folder = f"{shared_folder(spark)}/index-{uuid4().hex}"
        index.write_index(src.document_terms(spark, d), folder)
        _BUILT[key] = folder
    return index.Index.open(spark, _BUILT[key])


def _asked(spark, d):
    queries = src.search_queries(spark, d)
    return queries, settle(search.tokens(queries)), _index(spark, d)


def prefix_resolve(spark, d):
    _, asked, idx = _asked(spark, d)
    found = search.prefix_candidates(asked, idx.prefixes)
    return found.select("word", "candidate", "places", "blob_bytes", F.col("rn").cast("bigint").alias("rn"), F.col("run").cast("bigint").alias("run"))


def fuzzy_resolve(spark, d):
    _, asked, idx = _asked(spark, d)
    found = settle(search.prefix_candidates(asked, idx.prefixes))
    fuzzy = search.fuzzy_candidates(search.word_totals(asked, found), idx, found)
    return fuzzy.select("word", "candidate", F.round("score", 6).alias("score"), F.col("ord").cast("bigint").alias("ord"))


def similarity_ratio(spark, d):
    part = read(spark, d, "part")
    a = part.select(F.explode(words(normalise(F.col("p_name")))).alias("word")).distinct().withColumn("f", F.length("word"))
    b = part.select(F.explode(words(normalise(F.concat_ws(" ", "p_type", "p_name")))).alias("candidate")).distinct().withColumn("f", F.length("candidate"))
    return a.join(b, "f").select("word", "candidate", F.round(block_ratio("word", "candidate"), 6).alias("ratio"))


def word_similarity(spark, d):
    part, nation = read(spark, d, "part"), read(spark, d, "nation")
    a = nation.select(F.explode(words(normalise(F.col("n_name")))).alias("word")).distinct().withColumn("f", F.substring("word", 1, 1))
    b = part.select(F.explode(words(normalise(F.concat_ws(" ", "p_type", "p_name")))).alias("candidate")).distinct().withColumn("f", F.substring("candidate", 1, 1))
    return score_pairs(a.join(b, "f").select("word", "candidate")).select("word", "candidate", F.round("score", 6).alias("score"))


def tally_scores(spark, d):
    _, asked, idx = _asked(spark, d)
    t = search.tally(asked, settle(search.resolve(asked, idx)), idx.pairs)
    return t.select("query_id", F.col("i").cast("int").alias("i"), "place_id", F.round("score", 6).alias("score"), "exact")


def _kinds(spark, d):
    idx = _index(spark, d)
    return idx, *search.judged_places(idx, src.search_queries(spark, d))


def classify_hits(spark, d):
    kinds = _kinds(spark, d)[2]
    low, high = F.array_min("scores"), F.array_max("scores")
    return kinds.select("query_id", "place_id", "kind", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.col("exact_count").cast("int").alias("exact_count"))


def complete_partial(spark, d):
    idx, asked, kinds = _kinds(spark, d)
    done = search.complete(kinds, asked, idx.by_place)
    return done.select("query_id", "place_id", F.col("pn").cast("int").alias("pn"), F.round(search.total("scores") / F.col("k"), 6).alias("score"))


def _shown(hits: DataFrame) -> DataFrame:
    matched = F.array_join(F.transform("matched", lambda m: F.concat(m["word"], F.lit(":"), present.three_decimals(m["score"]))), ",")
    return hits.select(
        "query_id", F.col("pos").cast("int").alias("pos"), "place_id", F.round("score", 6).alias("score"), "exact_count", "is_area",
        "name", F.array_join("address", "|").alias("address"), matched.alias("matched"), F.round("metres", 3).alias("metres"),
    )


def search_topk(spark, d):
    idx = _index(spark, d)
    return _shown(search.search(idx, src.search_queries(spark, d)))


def rank_hits(spark, d):
    idx = _index(spark, d)
    hits = search.search(idx, src.search_queries(spark, d, lim=3))
    return hits.select("query_id", F.col("pos").cast("int").alias("pos"), "place_id", F.round("score", 6).alias("score"), "exact_count", "is_area")


def primary_related_split(spark, d):
    idx = _index(spark, d)
    parts = search.primary_and_related(search.search(idx, src.search_queries(spark, d, lim=30)))
    return parts.select("query_id", F.col("pos").cast("int").alias("pos"), "place_id", "part")


def primary_and_address(spark, d):
    shown = src.document_places(spark, d).select("place_id", present.display_name(F.col("name"), F.col("context")).alias("display"))
    return shown.select("place_id", "display", present.primary_name(F.col("display")).alias("name"), F.array_join(present.address_parts(F.col("display")), "|").alias("address"))


def matched_context(spark, d):
    part = read(spark, d, "part").withColumn("uk", src.cyrillic("p_name"))
    return part.select("p_partkey", present.matched_context(F.col("p_brand"), F.col("uk")).alias("latin"), present.matched_context(F.col("uk"), F.col("uk")).alias("kept"))


def distance_labels(spark, d):
    metres = equirectangular_m(F.lit(49.5), F.lit(24.0), F.col("lat"), F.col("lon"))
    rows = src.customer_places(spark, d).withColumn("m", metres)
    return rows.select("place_id", F.round("m", 3).alias("metres"), present.distance_label(F.col("m")).alias("label"), present.score_label((F.col("place_id") % 1001) / 1000.0).alias("score"))


def geo_links(spark, d):
    rows = src.customer_places(spark, d)
    lat, lon = F.col("lat"), F.col("lon")
    kind = F.get(F.array(F.lit("gps"), F.lit("place"), F.lit("map"), F.lit("none")), (F.col("place_id") % 4).cast("int"))
    return rows.select("place_id", present.geo_link(lat, lon).alias("short"), present.geo_link_labelled(lat, lon, F.col("name")).alias("labelled"), present.origin_label(kind, F.col("name"), lat, lon).alias("origin"))


def short_address(spark, d):
    part = read(spark, d, "part")
    street = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("вулиця "), src.cyrillic("p_brand"))).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("площа "), src.cyrillic("p_type")))
    parts = F.array_compact(F.array(F.when(F.col("p_partkey") % 5 < 2, street), F.col("p_name"), F.when(F.col("p_partkey") % 5 >= 2, street), F.col("p_brand")))
    return part.select("p_partkey", present.short_address(parts).alias("address"))


def _cyrillic(spark, d):
    return read(spark, d, "part").select("p_partkey", F.concat(src.cyrillic("p_name"), F.lit(" згода м'яч є-ї ющ"), src.cyrillic("p_type")).alias("uk"))


def romanise_official(spark, d):
    return _cyrillic(spark, d).select("p_partkey", "uk", romanise_kmu(F.col("uk")).alias("latin"))


def romanise_typed(spark, d):
    return _cyrillic(spark, d).select("p_partkey", romanise_naive(F.col("uk")).alias("latin"))


def cyrillic_test(spark, d):
    part = read(spark, d, "part")
    return part.select("p_partkey", is_cyrillic(src.cyrillic("p_name")).alias("uk"), is_cyrillic(F.col("p_name")).alias("en"))


def _near(df):
    return df.select("place_id", F.col("pos").cast("int").alias("pos"), "name", F.round("metres", 3).alias("metres"))


def knn_settlements(spark, d):
    kept = src.supplier_settlements(spark, d).where(F.col("rank").isin("city", "town", "village", "hamlet"))
    return _near(spatial.nearest(src.customer_places(spark, d), kept, WIDE.settlement_radius, 3))


def fallback_major(spark, d):
    return _near(spatial.nearby_settlements(src.customer_places(spark, d), src.supplier_settlements(spark, d)))


def nearest_subdivision(spark, d):
    return _near(spatial.nearest_subdivision(src.customer_places(spark, d), src.supplier_settlements(spark, d)))


def nearest_street(spark, d):
    found = spatial.nearest_street(src.customer_places(spark, d), src.part_streets(spark, d))
    return found.select("place_id", "name", "seq", F.round("metres", 3).alias("metres"))


def point_in_area(spark, d):
    return spatial.areas_of(src.customer_places(spark, d), src.nation_areas(spark, d)).select("place_id", "level", "name")


def context_assembly(spark, d):
    made = context.context(src.customer_places(spark, d), src.nation_areas(spark, d), src.supplier_settlements(spark, d), src.part_streets(spark, d), WIDE)
    return made.select("place_id", F.array_join("context", ", ").alias("context"))


def export_nodes(spark, d):
    part = read(spark, d, "part")
    places = part.select(F.col("p_partkey").alias("place_id"), F.lit(24.0).alias("lon"), F.lit(49.0).alias("lat"), F.concat(F.lit("shop="), "p_brand").alias("category"), src.cyrillic("p_type").alias("context"))
    names = ingest.name_variants(src.part_objects(spark, d))
    return export.export_nodes(places, names).select(F.col("node_id").cast("bigint").alias("node_id"), "place_id", "name", "key", "value")


def distinct_categories(spark, d):
    return export.distinct_categories(src.document_places(spark, d)).select(F.col("probe_id").cast("bigint").alias("probe_id"), "category")


def _rescued(spark, d):
    probes = export.distinct_categories(src.document_places(spark, d))
    kept = export.accepted(probes, probes.where("probe_id % 3 <> 0").select("probe_id"))
    key, value = present.split_category(F.col("category"))
    nodes = src.document_places(spark, d).select(F.col("place_id").alias("node_id"), key.alias("key"), value.alias("value"))
    return export.rescue(nodes, kept)


def rescue_tags(spark, d):
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["k"], F.lit("="), t["v"])), ",")
    return _rescued(spark, d).select("node_id", tags.alias("tags"), "rescued")


def count_audit(spark, d):
    nodes = _rescued(spark, d)
    lines = nodes.select(F.concat(F.lit("poi osmid="), F.col("node_id"), F.lit(" osmid="), F.col("node_id")).alias("value"))
    return export.audit(nodes, export.ids_in_text(lines)).select("written", "kept", "lost")


def asof_origin(spark, d):
    rows = src.events(spark, d)
    asked = rows.where("event_type = 'search' or event_type = 'purchase' or event_type = 'view'").select("user_id", "ts", "event_id")
    fixes = rows.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("fix_id"), "value")
    found = origin.asof_origin(asked, fixes)
    return found.select("event_id", "user_id", F.col("origin.fix_id").alias("fix_id"), F.col("origin.value").alias("value"))


def origin_reruns(spark, d):
    """Each change of an origin with the query that is searched again."""
    rows = src.events(spark, d)
    changes = rows.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("change_id"))
    asked = rows.where("event_type <> 'click'").select("user_id", "ts", F.col("event_id").alias("query_id"), F.col("event_type").alias("text"))
    return origin.reruns(changes, asked).select("change_id", "user_id", F.col("query.query_id").alias("query_id"), F.col("query.text").alias("text"))


def origin_states(spark, d):
    """The origin of each user after all events."""
    rows = src.events(spark, d)
    none = F.lit(None).cast("double")
    states = origin.origin_state(rows.select("user_id", "ts", "event_id", F.col("event_type").alias("kind"), F.col("value").alias("lat"), none.alias("lon"), F.col("event_type").alias("label")))
    return states.select("user_id", F.unix_micros("ts").alias("micros"), "kind", F.round("lat", 6).alias("lat"), "label")


def located_points(spark, d):
    """The representative point of nodes, lines and areas."""
    at = ingest.located(src.objects(spark, d))
    return at.select("osm_id", "osm_type", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def first_tags(spark, d):
    """The first tag of each object that is not its name."""
    tag = export.first_tag(F.col("tags"))
    return src.objects(spark, d).select("osm_id", tag["k"].alias("key"), tag["v"].alias("value"))


def point_in_slanted_area(spark, d):
    """Points in triangles with a triangular hole."""
    return spatial.areas_of(src.customer_places(spark, d), src.nation_triangles(spark, d)).select("place_id", "level", "name")


def debounce_queries(spark, d):
    return origin.debounced(src.events(spark, d), "6 hours").select("event_id", "user_id")


def latest_answers(spark, d):
    rows = src.events(spark, d).select("user_id", F.col("event_id").alias("request_id"), "event_type")
    return origin.latest_wins(rows).select("user_id", "request_id", "event_type")


def fix_throttle(spark, d):
    rows = src.events(spark, d).select("user_id", "ts", F.col("event_id").alias("fix_id"), "value")
    return origin.throttled(rows, "6 hours").select("user_id", F.unix_seconds("window_start").alias("window_start"), "fix_id", "value")


def ttl_filter(spark, d):
    rows = src.events(spark, d)
    return origin.fresh(rows, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "event_type")


def tags_json(spark, d):
    rows = src.events(spark, d).select("event_id", F.from_json("props", "map<string,string>").alias("tags"))
    return rows.select("event_id", F.to_json("tags").alias("tags"), F.size("tags").cast("bigint").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        normalise_text, tokenise_words, clean_whitespace, category_pick, role_split, bbox_filter, padded_sources, name_concat,
        name_variants_dedup, context_except, postings_build, postings_bytes, postings_codec, postings_roundtrip, prefix_resolve, fuzzy_resolve,
        similarity_ratio, word_similarity, tally_scores, classify_hits, complete_partial, rank_hits, search_topk,
        primary_related_split, primary_and_address, matched_context, distance_labels, geo_links, short_address, romanise_official,
        romanise_typed, cyrillic_test, knn_settlements, fallback_major, nearest_subdivision, nearest_street, point_in_area,
        context_assembly, export_nodes, distinct_categories, rescue_tags, count_audit, asof_origin, origin_reruns, origin_states, located_points, first_tags, point_in_slanted_area, debounce_queries,
        latest_answers, fix_throttle, ttl_filter, tags_json,
    )
}
