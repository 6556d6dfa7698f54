"""Distances and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def ecef(lat: Column, lon: Column, alt: Column | None = None) -> tuple[Column, Column, Column]:
    """WGS84 to earth-centred coordinates in metres."""
    alt = F.lit(0.0) if alt is None else alt
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + alt) * F.sin(phi)


def latlon(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Earth-centred to WGS84 by Bowring's formula."""
    b = A * (1 - FLAT)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * A, p * b)
    lat = F.atan2(z + (A * A - b * b) / b * F.pow(F.sin(t), 3), p - E2 * A * F.pow(F.cos(t), 3))
    return F.degrees(lat), F.degrees(F.atan2(y, x))
