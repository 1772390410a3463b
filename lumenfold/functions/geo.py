"""Distances and the time they take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8


@dataclass(frozen=True)
class Travel:
    """How long a way takes: a buffer and a rate on short drives, another on the rest, and walking."""

    short_miles: float = 5.0
    short_rate: float = 4.0
    long_rate: float = 1.8
    buffer: float = 5.0
    floor: float = 8.0
    walk_rate: float = 20.0
    walk_miles: float = 0.7


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.asin(F.sqrt(h)) * (2 * EARTH_MILES)


def drive_minutes(miles: Column, travel: Travel = Travel()) -> Column:  # noqa: B008
    short = travel.buffer + F.least(miles, F.lit(travel.short_miles)) * travel.short_rate
    whole = short + F.greatest(miles - travel.short_miles, F.lit(0.0)) * travel.long_rate
    return F.when(miles <= 0, F.lit(0)).otherwise(F.bround(F.greatest(F.lit(travel.floor), whole), 0)).cast("long")


def walk_minutes(miles: Column, travel: Travel = Travel()) -> Column:  # noqa: B008
    return F.bround(F.greatest(miles, F.lit(0.0)) * travel.walk_rate, 0).cast("long")


def leg(lat1: Column, lon1: Column, lat2: Column, lon2: Column, travel: Travel = Travel()) -> Column:  # noqa: B008
    """struct(miles, mode, minutes) of one way; unknown where an end can't be placed."""
    miles = F.bround(haversine(lat1, lon1, lat2, lon2), 1)
    mode = F.when(miles.isNull(), "unknown").when(miles <= travel.walk_miles, "walk").otherwise("drive")
    minutes = F.when(miles <= travel.walk_miles, walk_minutes(miles, travel)).otherwise(drive_minutes(miles, travel))
    return F.struct(miles.alias("miles"), mode.alias("mode"), F.when(miles.isNotNull(), minutes).alias("minutes"))
