"""Spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0
MERCATOR_LIMIT = 85.0511287798066
TAU = 2 * math.pi


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def wrap(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def destination(lon: Column, lat: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """Longitude and latitude reached along a great circle."""
    d, b, p = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    x = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return wrap(F.degrees(x)), F.degrees(q)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres; latitudes beyond the square are held at its edge."""
    p = F.radians(F.greatest(F.lit(-MERCATOR_LIMIT), F.least(F.lit(MERCATOR_LIMIT), lat)))
    return F.radians(lon) * MERCATOR_M, F.ln(F.tan(math.pi / 4 + p / 2)) * MERCATOR_M


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the Web Mercator tile that holds a point."""
    x, y = mercator(lon, lat)
    half, n = math.pi * MERCATOR_M, 1 << zoom
    hold = lambda v: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v))).cast("int")
    return hold((x + half) / (2 * half) * n), hold((half - y) / (2 * half) * n)


def beam_height(slant_m: Column, elevation_deg: Column, site_m: Column | float = 0.0) -> Column:
    """Height of a radar beam over the sea, 4/3-Earth model."""
    r, e = EARTH_M * 4 / 3, F.radians(elevation_deg)
    return F.sqrt(slant_m * slant_m + r * r + 2 * r * slant_m * F.sin(e)) - r + site_m


def slant_to_ground(slant_m: Column, elevation_deg: Column) -> Column:
    r, e = EARTH_M * 4 / 3, F.radians(elevation_deg)
    return r * F.asin(slant_m * F.cos(e) / (r + beam_height(slant_m, elevation_deg)))
