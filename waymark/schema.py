"""Parameters and table schemas."""

from __future__ import annotations

from dataclasses import dataclass

# Tag keys, ranks and levels of the data model, in order of preference.
STRONG_KEYS = (
    "amenity", "tourism", "shop", "leisure", "historic", "office", "craft", "healthcare", "emergency", "aeroway", "aerialway",
    "man_made", "military", "club", "sport", "public_transport", "mountain_pass", "place",
)
WEAK_KEYS = ("railway", "natural", "landuse", "waterway", "building")
NAME_KEYS = ("name", "alt_name", "old_name", "int_name", "official_name", "short_name", "loc_name", "nat_name", "reg_name")
SETTLEMENT_RANKS = ("city", "town", "village", "hamlet")
MAJOR_RANKS = ("city", "town")
NEARBY_RANKS = (*SETTLEMENT_RANKS, "suburb", "neighbourhood", "isolated_dwelling", "borough", "quarter", "locality")
ADMIN_LEVELS = ("8", "7", "6", "4")


@dataclass(frozen=True)
class ContextParams:
    """Radii (metres) and caps of the spatial context."""

    settlement_radius: float = 12_000.0
    major_radius: float = 40_000.0
    subdivision_radius: float = 1_500.0
    street_radius: float = 120.0
    settlements: int = 3
    subdivisions: int = 1
    parts: int = 6
    pad_degrees: float = 0.35


@dataclass(frozen=True)
class SearchParams:
    """Thresholds and caps of the search; the caps are part of its semantics."""

    min_score: float = 0.6
    max_length_gap: int = 3
    max_vocab_words: int = 500
    max_refs: int = 20_000
    max_incomplete: int = 400
    min_confident_places: int = 50
    min_fuzzy_word: int = 6
    probe_trim: int = 2
    min_probe: int = 3
    context_penalty: float = 0.01
    prefilter: int = 10
    exact_topk: bool = False


M_PER_DEG_LAT, M_PER_DEG_LON, EARTH_RADIUS_M = 110_574.0, 111_320.0, 6_371_000.0
LAST_CHAR = "￿"

POINT = "struct<lon: double, lat: double>"
OSM_OBJECT = f"osm_type string, osm_id bigint, seq bigint, tags array<struct<k: string, v: string>>, lon double, lat double, line array<{POINT}>, polys array<array<array<{POINT}>>>"
QUERY = "query_id bigint, text string, lim int, threshold double, lat double, lon double"
