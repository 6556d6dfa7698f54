"""Viewing geometry of conical and cross-track scanners, footprint directions and map projections, as column expressions. Lengths are in metres."""

from __future__ import annotations

from dataclasses import dataclass

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbitframe.functions.geo import ecef

RADIUS = 6_371_000.0


@dataclass(frozen=True)
class CrossTrack:
    altitude: float
    scan_range: float
    pixels: int
    scan_offset: float
    beam_width: float

    @property
    def ratio(self) -> float:
        return (RADIUS + self.altitude) / RADIUS

    def place(self, scan: Column, pixel: Column) -> tuple[Column, Column]:
        """Along-track and across-track place of a pixel: the beam's incidence less its angle at the sensor is the angle at the earth's centre."""
        beta = F.radians((pixel - self.pixels // 2) / F.lit(float(self.pixels)) * self.scan_range)
        return scan * self.scan_offset, RADIUS * (F.asin(F.sin(beta) * self.ratio) - beta)

    def pixel(self, along: Column, across: Column) -> tuple[Column, Column]:
        """Inverse of place."""
        alpha = across / RADIUS
        beta = F.atan2(F.sin(alpha), self.ratio - F.cos(alpha))
        return along / self.scan_offset, F.degrees(beta) / self.scan_range * self.pixels + self.pixels // 2

    def incidence(self, pixel: Column) -> Column:
        """Earth incidence angle in degrees across the scan."""
        beta = F.radians(-self.scan_range / 2 + pixel * (self.scan_range / (self.pixels - 1)))
        return F.degrees(F.asin(F.sin(beta) * self.ratio))

    def view(self, incidence: Column) -> Column:
        """Angle at the sensor, in radians, for an incidence angle; inside the scan."""
        limit = math.radians(self.scan_range / 2)
        return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.asin(F.sin(F.radians(incidence)) / self.ratio)))

    def resolution_across(self, incidence: Column) -> Column:
        beta = self.view(incidence)
        slope = self.ratio * F.cos(beta) / F.sqrt(1 - F.pow(self.ratio * F.sin(beta), 2)) - 1
        return RADIUS * slope * math.radians(self.beam_width)

    def resolution_along(self, incidence: Column) -> Column:
        """The beam's width at its slant range, which the resolution at nadir scales with."""
        theta = F.radians(incidence)
        slant = F.when(incidence == 0, F.lit(self.altitude)).otherwise(F.sin(theta - self.view(incidence)) / F.sin(theta) * (RADIUS + self.altitude))
        return slant / self.altitude * self.resolution_across(F.lit(0.0))

    def window_centre(self, position: Column, width: int) -> Column:
        """Middle pixel of a window at a relative position across the scan."""
        return F.rint((self.pixels - width) * position + width / 2)


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit(a: tuple[Column, ...]) -> tuple[Column, ...]:
    n = F.sqrt(dot(a, a))
    return a[0] / n, a[1] / n, a[2] / n


def up(lat: Column, lon: Column) -> tuple[Column, ...]:
    """Direction of the local vertical."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def rotation(at: tuple[Column, ...], before: tuple[Column, ...], after: tuple[Column, ...], vertical: tuple[Column, ...], craft: tuple[Column, ...]) -> Column:
    """Angle in degrees from the along-track direction to the view from the spacecraft, in the tangent plane. before and after are the same pixel's
    places in the neighbouring scans, null at the ends of the swath."""

    def step(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
        return unit(tuple(y - x for x, y in zip(a, b, strict=True)))

    one, two = step(before, at), step(at, after)
    along = tuple(F.coalesce((x + y) / 2, x, y) for x, y in zip(one, two, strict=True))
    across = cross(vertical, along)
    view = tuple(x - y for x, y in zip(at, craft, strict=True))
    return F.degrees(F.atan2(dot(view, across), dot(view, along)))


def radar_place(lat: float, lon: float, azimuth: Column, elevation: Column, distance: Column) -> tuple[Column, ...]:
    """Earth-centred place of a radar gate: along north, east and up at the radar."""
    phi, lam = math.radians(lat), math.radians(lon)
    north = (-math.sin(phi) * math.cos(lam), -math.sin(phi) * math.sin(lam), math.cos(phi))
    east = (-math.sin(lam), math.cos(lam), 0.0)
    vertical = (math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi))
    here = ecef(F.lit(lat), F.lit(lon))
    flat, az, el = distance * F.cos(F.radians(elevation)), F.radians(azimuth), F.radians(elevation)
    return tuple(h + flat * (F.cos(az) * n + F.sin(az) * e) + distance * F.sin(el) * u for h, n, e, u in zip(here, north, east, vertical, strict=True))


def equal_area(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Lambert's azimuthal equal-area projection about a point."""
    p0, phi, lam = math.radians(lat0), F.radians(lat), F.radians(lon - lon0)
    k = F.sqrt(2 / (1 + math.sin(p0) * F.sin(phi) + math.cos(p0) * F.cos(phi) * F.cos(lam)))
    return RADIUS * k * F.cos(phi) * F.sin(lam), RADIUS * k * (math.cos(p0) * F.sin(phi) - math.sin(p0) * F.cos(phi) * F.cos(lam))


def equal_area_inverse(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    p0, rho = math.radians(lat0), F.sqrt(x * x + y * y)
    c = 2 * F.asin(rho / (2 * RADIUS))
    s = F.when(rho == 0, 0.0).otherwise(F.sin(c) / rho)
    lat = F.asin(F.cos(c) * math.sin(p0) + y * s * math.cos(p0))
    lon = F.atan2(x * s, F.cos(c) * math.cos(p0) - y * s * math.sin(p0))
    return F.degrees(lat), lon0 + F.degrees(lon)
