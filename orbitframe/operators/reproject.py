"""A scene as another instrument would see it: places of its pixels in a swath, by way of distances on the ground, and interpolation there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions.geo import ecef
from orbitframe.functions.geometry import CrossTrack, dot, cross, unit, up


def swath_places(swath: DataFrame, by: list[str], scan: str, pixel: str, lat: str, lon: str) -> DataFrame:
    """(by, j, across, along, step, n_scans): distances in metres of each pixel of a swath's middle scan from its middle pixel, across and along the
    track, and the distance to the next scan. One row a pixel of one scan, as scans of an instrument have one shape."""
    size = swath.groupBy(*by).agg((F.max(scan) + 1).alias("n_scans"), (F.max(pixel) + 1).alias("__m"))
    here = swath.join(size, by).withColumns({"__c": F.expr("cast(floor(n_scans / 2) as bigint)"), "__p": F.expr("cast(floor(__m / 2) as bigint)")})
    here = here.where(F.col(scan).between(F.col("__c"), F.col("__c") + 1))
    x, y, z = ecef(F.col(lat), F.col(lon))
    here = here.select(*by, "n_scans", (F.col(scan) - F.col("__c")).alias("__s"), F.col(pixel).alias("j"), (F.col(pixel) == F.col("__p")).alias("__mid"), x.alias("__x"), y.alias("__y"), z.alias("__z"), F.col(lat).alias("__lat"), F.col(lon).alias("__lon"))
    at = lambda s: F.max(F.when(F.col("__mid") & (F.col("__s") == s), F.struct("__x", "__y", "__z", "__lat", "__lon")))
    frame = here.groupBy(*by).agg(at(0).alias("__o"), at(1).alias("__n"))
    rows = here.where("__s = 0").join(frame, by)
    origin, following = (tuple(F.col(f"{k}.{c}") for c in ("__x", "__y", "__z")) for k in ("__o", "__n"))
    forward = tuple(b - a for a, b in zip(origin, following, strict=True))
    along = unit(forward)
    right = cross(along, up(F.col("__o.__lat"), F.col("__o.__lon")))
    away = tuple(F.col(c) - o for c, o in zip(("__x", "__y", "__z"), origin, strict=True))
    return rows.select(*by, "j", dot(away, right).alias("across"), dot(away, along).alias("along"), F.sqrt(dot(forward, forward)).alias("step"), "n_scans")


def window_places(places: DataFrame, by: list[str], geometry: CrossTrack, height: int, width: int, position: float, centre_in: int, down: float) -> DataFrame:
    """(by, row, col, scan, pixel): for each pixel of a window of another geometry its fractional place in the swath of `places`; null across beyond the
    swath. `position` is the window's place across the other scan (0 to 1), `centre_in` the swath's pixel under its middle, `down` its place along the
    scene: 0 puts the first row of places at the first scan, 1 the last at the last scan."""
    column = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col")
    middle = geometry.window_centre(F.lit(position), width)
    across = geometry.place(F.lit(0), middle + F.col("col") - width // 2)[1] - geometry.place(F.lit(0), middle)[1]
    centre = places.where(F.col("j") == centre_in)
    wanted = centre.select(*by, "step", "n_scans", F.col("along").alias("__a0"), F.col("across").alias("__x0"), column)
    wanted = wanted.select(*by, "step", "n_scans", "__a0", "col", (across + F.col("__x0")).alias("__x"))
    right = places.select(*by, (F.col("j") - 1).alias("j"), F.col("across").alias("__xr"), F.col("along").alias("__ar"))
    gaps = places.select(*by, "j", F.col("across").alias("__xl"), F.col("along").alias("__al")).join(right, [*by, "j"])
    low, high = F.least("__xl", "__xr"), F.greatest("__xl", "__xr")
    # as many gaps as a scan has pixels, for each of the window's columns
    inside = wanted.select(*by, "col", "__x").join(gaps, by).where((F.col("__x") >= low) & (F.col("__x") <= high))
    part = (F.col("__x") - F.col("__xl")) / (F.col("__xr") - F.col("__xl"))
    found = inside.groupBy(*by, "col").agg(F.min(F.struct("j", part.alias("part"), (F.col("__al") + part * (F.col("__ar") - F.col("__al"))).alias("along"))).alias("__f"))
    columns = wanted.join(found, [*by, "col"], "left")
    rows = columns.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    behind = (F.col("row") - height // 2) * geometry.scan_offset + F.col("__a0") - F.col("__f.along")
    rows = rows.select(*by, "row", "col", "n_scans", (behind / F.col("step") + F.floor(F.col("n_scans") / 2)).alias("scan"), (F.col("__f.j") + F.col("__f.part")).alias("pixel"))
    reach = rows.groupBy(*by).agg(F.min("scan").alias("__lo"), F.max("scan").alias("__hi"))
    shift = -F.col("__lo") + down * (F.col("n_scans") - 1 - F.col("__hi") + F.col("__lo"))
    return rows.join(reach, by).select(*by, "row", "col", (F.col("scan") + shift).alias("scan"), "pixel")


def remap(places: DataFrame, source: DataFrame, by: list[str], scan: str, pixel: str, value: str, order: int = 1) -> DataFrame:
    """(by, row, col, value): the source at fractional places (by, row, col, scan, pixel), nearest (order 0) or bilinear (1); null where a pixel that
    counts is missing or beyond the edge. An equi-join on the corners, one or four a place."""
    data = source.select(*by, F.col(scan).alias("__i"), F.col(pixel).alias("__j"), F.col(value).alias("__v"))

    def corner(i: Column, j: Column, weight: Column) -> Column:
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), weight.alias("w"))

    s, p = F.col("scan"), F.col("pixel")
    if order == 0:
        corners = F.array(corner(F.floor(s + 0.5), F.floor(p + 0.5), F.lit(1.0)))
    else:
        i, j = F.floor(s), F.floor(p)
        u, v = s - i, p - j
        corners = F.array(*(corner(i + a, j + b, (u if a else 1 - u) * (v if b else 1 - v)) for a in (0, 1) for b in (0, 1)))
    each = places.select(*by, "row", "col", F.explode(corners).alias("c")).select(*by, "row", "col", F.col("c.i").alias("__i"), F.col("c.j").alias("__j"), F.col("c.w").alias("__w"))
    met = each.join(data, [*by, "__i", "__j"], "left")
    counts = F.coalesce(F.col("__w") > 0, F.lit(True))
    summed = met.groupBy(*by, "row", "col").agg(F.sum(F.when(counts, F.col("__w") * F.col("__v"))).alias("__s"), F.count_if(counts & (F.col("__v").isNull() | F.col("__w").isNull())).alias("__gaps"))
    return summed.select(*by, "row", "col", F.when(F.col("__gaps") == 0, F.col("__s")).alias(value))
