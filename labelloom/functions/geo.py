"""Distances and coordinates in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of places from general to special (countries and regions,
# settlements, waters, areas, mountains, undersea, vegetation, roads, spots).
FEATURE_ORDER = "A P H L T U V R S".split()
METRES_PER_FOOT = 0.3048

_DEGREES = r"(\d+(?:\.\d+)?)\s?[°*]?\s?(\d+(?:\.\d+)?)\s?['’,.*]?\s?(?:(\d+(?:\.\d+)?)\s?[\"”'.*,]?)?\s?"
LATLNG = rf"(?iu)\b{_DEGREES}([CСNЮS])[A-Z]*(?:[,.]\s+|\s+){_DEGREES}([ВЗEW])[A-Z]*"


def distance_metres(s: Column) -> Column:
    """The first distance of a text in metres; null without one."""
    pattern = r"(?i)([0-9]+)\s?(k?m|ft)"
    value, unit = F.regexp_extract(s, pattern, 1), F.lower(F.regexp_extract(s, pattern, 2))
    factor = F.when(unit == "km", 1000.0).when(unit == "ft", METRES_PER_FOOT).otherwise(1.0)
    return F.when(value != "", value.cast("double") * factor)


def feet(metres: Column) -> Column:
    return metres / METRES_PER_FOOT


def decimal(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return degrees + (minutes + seconds / 60) / 60


def dms(value: Column) -> Column:
    """Degrees, minutes and seconds of a decimal value, with carry."""
    total = F.round(F.abs(value) * 3600, 6)
    return F.struct(F.floor(total / 3600).cast("int").alias("deg"), F.floor((total % 3600) / 60).cast("int").alias("min"), (total % 60).alias("sec"))


def cardinal(s: Column) -> Column:
    """N, S, E or W from the first letter, Latin or Cyrillic."""
    first = F.upper(F.left(s, F.lit(1)))
    return F.when(first.isin("C", "С", "N"), "N").when(first.isin("Ю", "S"), "S").when(first.isin("В", "E"), "E").when(first.isin("З", "W"), "W")


def latlng(s: Column) -> Column:
    """``struct<lat, lng, verbatim>`` of the first coordinates in degrees and minutes; null without any."""
    g = [F.regexp_extract(s, LATLNG, i) for i in range(1, 9)]

    def value(d, m, sec, card, negative):
        return decimal(d.cast("double"), m.cast("double"), F.coalesce(F.when(sec != "", sec).cast("double"), F.lit(0.0))) * F.when(cardinal(card) == negative, -1.0).otherwise(1.0)

    return F.when(g[0] != "", F.struct(value(g[0], g[1], g[2], g[3], "S").alias("lat"), value(g[4], g[5], g[6], g[7], "W").alias("lng"), F.regexp_extract(s, LATLNG, 0).alias("verbatim")))


def feature_rank(fcl: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, FEATURE_ORDER)), fcl) - 1
