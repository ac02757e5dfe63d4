"""Planar geometry on longitude and latitude, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.schema import EARTH_RADIUS_M, M_PER_DEG_LAT, M_PER_DEG_LON


def m_per_deg_lon(lat: Column) -> Column:
    return F.lit(M_PER_DEG_LON) * F.cos(F.radians(lat))


def planar_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between near points, with the scale of the first."""
    dx, dy = (lon2 - lon1) * m_per_deg_lon(lat1), (lat2 - lat1) * F.lit(M_PER_DEG_LAT)
    return F.sqrt(dx * dx + dy * dy)


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere, with the scale of the mean latitude."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = F.radians(lat2 - lat1)
    return F.sqrt(dx * dx + dy * dy) * F.lit(EARTH_RADIUS_M)


def degree_radius(metres: float, lat: Column) -> Column:
    """Degrees of longitude that cover ``metres`` up to a latitude; all of them at the poles."""
    return F.least(F.lit(360.0), F.lit(metres) / F.greatest(m_per_deg_lon(lat), F.lit(1e-6)))


def band_width(band: Column, metres: float) -> Column:
    """The width in degrees of the cells in a band of latitude that is ``metres`` high: at least so many metres."""
    high = metres / M_PER_DEG_LAT
    edge = F.greatest(F.abs(band), F.abs(band + 1)) * F.lit(high)
    return degree_radius(metres, F.least(edge, F.lit(90.0)))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def ring_edges(ring: Column) -> Column:
    """The edges (a, b) of a ring or line of points."""
    return F.zip_with(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def in_edges(lon: Column, lat: Column, edges: Column) -> Column:
    """Whether a point lies in or on the boundary that the edges draw (by parity, so holes are left out)."""

    def on(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        straight = (bx - ax) * (lat - ay) == (by - ay) * (lon - ax)
        return straight & lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        return ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / (by - ay) + ax)

    odd = F.aggregate(edges, F.lit(False), lambda inside, e: inside != crosses(e))
    return F.exists(edges, on) | odd


def polygon_edges(polys: Column) -> Column:
    """The edges of all rings of polygons."""
    return F.flatten(F.transform(F.flatten(polys), ring_edges))


def nearest_on_segment(lon: Column, lat: Column, a: Column, b: Column) -> Column:
    """The point of a segment that is nearest in degrees."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    size = dx * dx + dy * dy
    along = ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / F.when(size > 0, size)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    return F.struct((a["lon"] + t * dx).alias("lon"), (a["lat"] + t * dy).alias("lat"))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value found once: a Spark expression is found anew wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_centroid(line: Column) -> Column:
    """The length-weighted centroid of a line; of a point-like line its first point."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))

    def add(s: Column, e: Column) -> Column:
        dx, dy = e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"]
        w = F.sqrt(dx * dx + dy * dy)
        return F.struct(
            (s["w"] + w).alias("w"), (s["lon"] + w * (e["a"]["lon"] + e["b"]["lon"]) / 2).alias("lon"),
            (s["lat"] + w * (e["a"]["lat"] + e["b"]["lat"]) / 2).alias("lat"),
        )

    total = F.aggregate(ring_edges(line), zero, add)
    first = F.get(line, F.lit(0))
    return once(total, lambda t: F.when(t["w"] > 0, F.struct((t["lon"] / t["w"]).alias("lon"), (t["lat"] / t["w"]).alias("lat"))).otherwise(first))


def polygons_centroid(polys: Column) -> Column:
    """The area-weighted centroid; the first ring of a polygon adds, its others (holes) take away."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    origin = F.get(F.get(F.get(polys, F.lit(0)), F.lit(0)), F.lit(0))

    def ring(points: Column) -> Column:
        def add(s: Column, e: Column) -> Column:
            ax, ay = e["a"]["lon"] - origin["lon"], e["a"]["lat"] - origin["lat"]
            bx, by = e["b"]["lon"] - origin["lon"], e["b"]["lat"] - origin["lat"]
            w = ax * by - bx * ay
            return F.struct((s["w"] + w).alias("w"), (s["lon"] + w * (ax + bx) / 3).alias("lon"), (s["lat"] + w * (ay + by) / 3).alias("lat"))

        return F.aggregate(ring_edges(points), zero, add)

    def add_ring(s: Column, part: Column) -> Column:
        sign = F.when((part["sum"]["w"] < 0) == part["outer"], -1.0).otherwise(1.0)
        return F.struct(*((s[k] + sign * part["sum"][k]).alias(k) for k in ("w", "lon", "lat")))

    parts = F.flatten(F.transform(polys, lambda p: F.transform(p, lambda r, k: F.struct(ring(r).alias("sum"), (k == 0).alias("outer")))))
    total = F.aggregate(parts, zero, add_ring)
    return once(total, lambda t: F.when(t["w"] != 0, F.struct((origin["lon"] + t["lon"] / t["w"]).alias("lon"), (origin["lat"] + t["lat"] / t["w"]).alias("lat"))).otherwise(origin))
