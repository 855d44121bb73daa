"""Spherical geometry as column expressions; distances in kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the haversine is clipped to [0, 1], so antipodes and rounding give no NaN."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a, b = F.sin((p2 - p1) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = a * a + F.cos(p1) * F.cos(p2) * b * b
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """x, y, z on the unit sphere."""
    p, q = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)


def arc_km(chord: Column) -> Column:
    """The great-circle distance of a chord of the unit sphere."""
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord / 2)))


def inside(value: Column, low, high) -> Column:
    """Inclusive range test that is false for nulls."""
    return F.coalesce(value.between(low, high), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null where ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
