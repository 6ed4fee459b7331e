"""Distances on the globe and session texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METERS_PER_DEGREE = 111_320.0
EQUATOR_M = 40_075_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle meters; null if any argument is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a - F.greatest(a - 1, F.lit(0.0))))  # at most 1, and null stays null


def north_east_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column, Column]:
    """(north, east, distance) meters from point 1 to point 2, on a local plane."""
    north = (lat2 - lat1) * METERS_PER_DEGREE
    east = (lon2 - lon1) * (EQUATOR_M * F.cos(F.radians((lat1 + lat2) / 2)) / 360)
    return north, east, F.sqrt(north * north + east * east)


def log1p_safe(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def duration_text(minutes: Column) -> Column:
    """Whole hours and minutes, as '3時間05分' without padding."""
    whole = F.floor(minutes).cast("int")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit("時間"), (whole % 60).cast("string"), F.lit("分"))


def map_url(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps?q="), F.format_string("%.6f", lat), F.lit(","), F.format_string("%.6f", lon))
