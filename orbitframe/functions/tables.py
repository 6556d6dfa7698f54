"""Lookups in evenly spaced tables and rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_lookup(x: Column, start: float, step: float, values: list[float]) -> Column:
    """Linear between the entries of an evenly spaced table, constant beyond its ends."""
    table = F.array(*(F.lit(float(v)) for v in values))
    at = F.greatest(F.least((x - start) / step, F.lit(float(len(values) - 1))), F.lit(0.0))
    low = F.least(F.floor(at), F.lit(len(values) - 2)).cast("int")
    part = at - low
    return F.when(x.isNotNull(), F.get(table, low) * (1 - part) + F.get(table, low + 1) * part)


def frozen_precip(twb: Column, surface: Column, precip: Column, start: float, step: float, ocean: list[float], land: list[float]) -> Column:
    """Precipitation that is frozen at a wet-bulb temperature (degrees Celsius): the tables hold the liquid share in per cent. Negative
    precipitation is missing."""
    liquid = F.when(surface == 1, uniform_lookup(twb, start, step, ocean)).otherwise(uniform_lookup(twb, start, step, land))
    return F.when(precip >= 0, (1 - liquid / 100) * precip)


def resize(values: Column, n: int, m: int) -> Column:
    """A row of n values at m evenly spaced places from its first to its last, linear in between."""

    def at(j: Column) -> Column:
        place = j * (n - 1) / F.lit(float(m - 1))
        low = F.least(F.floor(place), F.lit(n - 2)).cast("int")
        return F.get(values, low) * (1 - (place - low)) + F.get(values, low + 1) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), at)
