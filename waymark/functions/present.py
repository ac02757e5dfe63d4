"""How hits, distances and places are shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.text import is_cyrillic, romanise_kmu


def display_name(name: Column, context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(name, F.lit(" ("), context, F.lit(")"))).otherwise(name)


def matched_context(name: Column, context: Column) -> Column:
    """A Latin name gets its Cyrillic context in Latin letters."""
    return F.when(~is_cyrillic(name) & is_cyrillic(context), romanise_kmu(context)).otherwise(context)


def primary_name(display: Column) -> Column:
    return F.substring_index(display, " (", 1)


def address_parts(display: Column) -> Column:
    at = F.instr(display, " (")
    inner = F.substring(display, at + 2, F.length(display) - at - 2)
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(at > 0, parts).otherwise(F.filter(F.array(F.lit("")), lambda p: F.lit(False)))


def is_area(category: Column) -> Column:
    return category.startswith("place=") | category.startswith("boundary=administrative")


def split_category(category: Column) -> tuple[Column, Column]:
    """Key and value at the first "="."""
    at = F.instr(category, "=")
    return F.when(at > 0, F.substring(category, F.lit(1), at - 1)).otherwise(category), F.when(at > 0, F.substring(category, at + 1, F.length(category))).otherwise(F.lit(""))


# Words that begin a street's name.
STREET_STARTS = ("вулиця ", "площа ")


def short_address(parts: Column, starts: tuple[str, ...] = STREET_STARTS) -> Column:
    """The first part that is no street, then the first that is."""
    street = lambda p: reduce(Column.__or__, (p.startswith(s) for s in starts))
    other = F.get(F.filter(parts, lambda p: ~street(p)), F.lit(0))
    return F.concat_ws(", ", other, F.get(F.filter(parts, street), F.lit(0)))


def distance_label(metres: Column) -> Column:
    km = metres / 1000
    return (
        F.when(metres < 1000, F.format_string("%d m", F.round(metres).cast("bigint")))
        .when(metres < 10_000, F.format_string("%.1f km", km))
        .when(metres.isNotNull(), F.format_string("%.0f km", km))
    )


def score_label(score: Column) -> Column:
    return F.when(score >= 0.999, "1.00").otherwise(F.format_string("%.2f", score))


def geo_link(lat: Column, lon: Column) -> Column:
    return F.format_string("geo:%.5f,%.5f", lat, lon)


def geo_link_labelled(lat: Column, lon: Column, label: Column) -> Column:
    at = F.format_string("%.6f,%.6f", lat, lon)
    return F.concat(F.lit("geo:"), at, F.lit("?q="), at, F.lit("("), F.replace(F.url_encode(label), F.lit("+"), F.lit("%20")), F.lit(")"))


def origin_label(kind: Column, label: Column, lat: Column, lon: Column) -> Column:
    return (
        F.when(kind == "gps", "GPS").when(kind == "place", label)
        .when(kind == "map", F.format_string("%.4f, %.4f (map)", lat, lon)).otherwise("")
    )


def hit_line(score: Column, exact: Column, name: Column, address: Column, lat: Column, lon: Column, metres: Column) -> Column:
    """One line of the command line's output."""
    far = F.when(metres.isNotNull(), F.concat(F.lit("  "), F.format_string("%.1f km", metres / 1000))).otherwise("")
    where = F.array_join(address, ", ")
    return F.concat(F.format_string("%.2f  ex:%d  %s  (%s)  ", score, exact, name, where), geo_link(lat, lon), far)


def three_decimals(score: Column) -> Column:
    """A score that is 0 or from 1/64 to 8 with three decimals, rounded as C does: by all its binary digits, exact halves to even.

    ``format_string`` rounds the shortest decimal digits half up, which differs for 0.8125 or 0.9275.
    """
    bits = 1 << 59
    thousand = F.floor(score * F.lit(float(bits))).cast("decimal(20,0)") * F.lit(1000).cast("decimal(5,0)")
    whole = F.floor(score * 1000).cast("bigint")
    # The product above may be rounded up to the next whole number.
    whole = F.when(whole.cast("decimal(10,0)") * F.lit(bits).cast("decimal(20,0)") > thousand, whole - 1).otherwise(whole)
    rest = thousand - whole.cast("decimal(10,0)") * F.lit(bits).cast("decimal(20,0)")
    half = F.lit(bits // 2).cast("decimal(20,0)")
    near = whole + F.when((rest > half) | ((rest == half) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(near / 1000).cast("string"), F.lit("."), F.lpad((near % 1000).cast("string"), 3, "0"))
