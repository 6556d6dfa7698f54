"""Validity: sentinels and NaN become null once, limits, and the predicate of the verification metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -9999.0


def null_if_missing(c: Column) -> Column:
    """NaN and values at or below -999 are null."""
    c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return F.when(c > -999, c)


def limits(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null outside [low, high]; None is unbounded."""
    keep = within(c, low, high)
    return F.when(keep, c)


def within(c: Column, low: float | None = None, high: float | None = None) -> Column:
    keep = c.isNotNull()
    if low is not None:
        keep = keep & (c >= low)
    if high is not None:
        keep = keep & (c <= high)
    return keep


def valid(no_sea_ice=True, no_ocean=False, no_orographic=False, no_snow=False, frozen: tuple[int, ...] = (), rqi: float | None = None, box: tuple | None = None) -> Column:
    """Rows that count in a metric: both rates present and not negative, and the given classes left out. box is (lon0, lat0, lon1, lat1)."""
    keep = (F.col("surface_precip") >= 0) & (F.col("surface_precip_ref") >= 0)
    st = F.col("surface_type")
    if no_sea_ice:
        keep = keep & ~st.isin(2, 16)
    if no_ocean:
        keep = keep & (st > 1)
    if no_orographic:
        keep = keep & (st < 17)
    if no_snow:
        keep = keep & ((st < 8) | (st > 11))
    if frozen:
        keep = keep & ~F.col("mask").isin(*frozen)
    if rqi is not None:
        keep = keep & (F.col("rqi") > rqi)
    if box:
        keep = keep & (F.col("longitude") >= box[0]) & (F.col("latitude") >= box[1]) & (F.col("longitude") <= box[2]) & (F.col("latitude") <= box[3])
    return keep


def signed_round(c: Column, digits: int) -> Column:
    """Rounded half away from zero as SQL engines do that keep the sign of a zero: -0.0000001 becomes -0.0."""
    return F.signum(c) * F.round(F.abs(c), digits)
