"""Physical rules and encodings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the surface classes 1 to 18.
SURFACES = (
    "Ocean", "Sea-Ice", "Vegetation 1", "Vegetation 2", "Vegetation 3", "Vegetation 4", "Vegetation 5", "Snow 1", "Snow 2", "Snow 3", "Snow 4",
    "Standing Water", "Land Coast", "Mixed land/ocean o. water", "Ocean or water Coast", "Sea-ice edge", "Mountain Rain", "Mountain Snow",
)


def surface_name(code: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in SURFACES)), code - 1)


def pixel_status(lat: Column, tbs: Column, ancillary: list[Column]) -> Column:
    """4 bad ancillary, else 2 a temperature outside [40, 325], else 1 bad location, else 0."""
    bad = ancillary[0] < 0
    for a in ancillary[1:]:
        bad = bad | (a < 0)
    return F.when(bad, 4).when(F.exists(tbs, lambda t: (t < 40) | (t > 325)), 2).when((lat < -90) | (lat > 90), 1).otherwise(0)


def clip_round(c: Column, low: float, high: float) -> Column:
    """Half to even, then into [low, high]."""
    return F.least(F.greatest(F.rint(c), F.lit(low)), F.lit(high)).cast("int")


def t2m_index(t: Column) -> Column:
    return (F.greatest(F.least(F.rint((t - 268) / 3), F.lit(12.0)), F.lit(1.0)) - 1).cast("int")


def to_linear(dbz: Column) -> Column:
    return F.pow(F.lit(10.0), dbz / 10)


def to_dbz(z: Column) -> Column:
    return 10 * F.log10(F.when(z > 0, z))


def snow_correction(sp: Column, snow: Column, ratio: Column) -> Column:
    return sp - snow + snow * ratio


def one_hot(code: Column, first: int, last: int) -> Column:
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: (code == i).cast("int"))


def expand_channels(tbs: Column, gaps: tuple[int, ...] = (5, 12)) -> Column:
    """Thirteen channels at their places among fifteen; null elsewhere."""
    order = [i for i in range(15) if i not in gaps]
    return F.array(*(F.get(tbs, F.lit(order.index(i))) if i in order else F.lit(None).cast("double") for i in range(15)))


def path_integral(profile: Column, heights: list[float]) -> Column:
    """Trapezoid rule over heights in km."""
    total = F.lit(0.0)
    for i in range(1, len(heights)):
        total = total + (F.get(profile, F.lit(i)) + F.get(profile, F.lit(i - 1))) * (heights[i] - heights[i - 1]) / 2
    return total


def interpolation_weights(x: Column, grid: list[float]) -> Column:
    """Linear weights on an ascending or descending grid, clamped at its ends, in the grid's order."""
    order = sorted(range(len(grid)), key=grid.__getitem__)
    g = [grid[i] for i in order]
    c = F.least(F.greatest(x, F.lit(g[0])), F.lit(g[-1]))
    out: dict[int, Column] = {}
    for k, i in enumerate(order):
        w = F.when(c == g[k], 1.0)
        if k:
            w = w.when((c > g[k - 1]) & (c < g[k]), (c - g[k - 1]) / (g[k] - g[k - 1]))
        if k + 1 < len(g):
            w = w.when((c > g[k]) & (c < g[k + 1]), (g[k + 1] - c) / (g[k + 1] - g[k]))
        out[i] = w.otherwise(0.0)
    return F.array(*(out[i] for i in range(len(grid))))


def quantile_mean(q: Column, levels: list[float]) -> Column:
    """Mean of a distribution given by quantiles: linear in between, constant in the tails."""
    n = len(levels)
    total = F.get(q, F.lit(0)) * levels[0] + F.get(q, F.lit(n - 1)) * (1 - levels[-1])
    for i in range(1, n):
        total = total + (F.get(q, F.lit(i)) + F.get(q, F.lit(i - 1))) * (levels[i] - levels[i - 1]) / 2
    return total


def exceedance(q: Column, levels: list[float], y: float) -> Column:
    """P(value > y) from quantiles, linear in between."""
    p = F.when(F.get(q, F.lit(0)) > y, 1.0 - levels[0]).when(F.get(q, F.lit(len(levels) - 1)) <= y, 1.0 - levels[-1])
    for i in range(1, len(levels)):
        a, b = F.get(q, F.lit(i - 1)), F.get(q, F.lit(i))
        p = p.when((a <= y) & (b > y), 1 - (levels[i - 1] + (levels[i] - levels[i - 1]) * (y - a) / (b - a)))
    return p


# Orographic enhancement by source of the ancillary data, (surface class, airmass class): factor; 1 elsewhere.
ENHANCEMENT = {
    "ERA5": {(17, 0): 1.35683, (17, 1): 2.05213, (17, 2): 1.62242, (17, 3): 1.87049, (18, 0): 3.91369},
    "GANAL": {(17, 0): 1.58177, (17, 1): 1.81539, (18, 0): 3.91369},
}


def enhancement(surface: Column, airmass: Column, kind: str = "ERA5") -> Column:
    """Factor on precipitation over mountains."""
    out = F.when(F.lit(False), 1.0)
    for (s, a), factor in ENHANCEMENT[kind.upper()].items():
        out = out.when((surface == s) & (airmass == a), factor)
    return out.otherwise(1.0)


def conical_x(pixel: Column, n: int, scan_range: float, radius_km: float) -> Column:
    """Across-track place in km of a pixel of a conical scan; the middle pixel is at 0."""
    return radius_km * F.sin(F.radians((pixel - (n - 1) / 2) * (scan_range / n)))


def conical_pixel(x: Column, n: int, scan_range: float, radius_km: float) -> Column:
    """Inverse of conical_x."""
    return F.degrees(F.asin(x / radius_km)) / (scan_range / n) + (n - 1) / 2
