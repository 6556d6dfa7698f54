"""Smoothing by the viewing angle, smoothed classes, Haar packets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions.geo import great_circle
from orbitframe.functions.geometry import cross, unit


def _sent(df: DataFrame, by: list[str], y: str, x: str, radius: int, columns: list) -> DataFrame:
    """Rows dealt to all places within the radius; (dy, dx) points from the place to the row."""
    span = range(-radius, radius + 1)
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in span for b in span)))
    return df.select(*by, y, x, *columns, steps.alias("k")).select(*by, (F.col(y) - F.col("k.dy")).alias(y), (F.col(x) - F.col("k.dx")).alias(x), *columns, F.col("k.dy").alias("dy"), F.col("k.dx").alias("dx"))


def smooth_rotated(df: DataFrame, by: list[str], y: str, x: str, value: str, angle: str, along: float, across: float, radius: int, steps: int = 11) -> DataFrame:
    """(by, y, x, smooth): mean under a Gaussian with the widths along and across the direction of each place's own angle (degrees, folded into
    -90 to 90). As kernels are given for `steps` evenly spaced angles, the means under the two nearest are blended linearly. Missing values
    do not count; a place without an angle or with a missing value of its own is null."""
    width = 180.0 / (steps - 1)
    folded = F.pmod(F.col(angle) + 90, F.lit(180.0)) / width
    low = F.least(F.floor(folded), F.lit(steps - 2))
    places = df.where(F.col(value).isNotNull()).select(*by, y, x, low.alias("low"), (folded - low).alias("part"))
    sent = _sent(df.where(F.col(value).isNotNull()), by, y, x, radius, [F.col(value)]).join(places, [*by, y, x])

    def weight(k):
        a = F.radians(k * width - 90)
        u, v = F.col("dx") * F.cos(a) + F.col("dy") * F.sin(a), F.col("dy") * F.cos(a) - F.col("dx") * F.sin(a)
        return F.exp(-0.5 * (u * u / (across * across) + v * v / (along * along)))

    sums = sent.select(*by, y, x, "part", value, weight(F.col("low")).alias("w0"), weight(F.col("low") + 1).alias("w1")).groupBy(*by, y, x)
    mean = lambda w: F.sum(F.col(w) * F.col(value)) / F.sum(w)
    out = sums.agg(F.first("part").alias("part"), mean("w0").alias("m0"), mean("w1").alias("m1"))
    return out.select(*by, y, x, (F.col("m0") * (1 - F.col("part")) + F.col("m1") * F.col("part")).alias("smooth"))


def smooth_classes(df: DataFrame, by: list[str], y: str, x: str, code: str, kernel: list[tuple[int, int, float]], least: float = 0.5) -> DataFrame:
    """(by, y, x, smooth): at each given place the class with the largest share under the kernel, 0 where no share reaches `least`, -1 where
    the place's own code is negative or missing. Of equal shares the smaller class wins."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(w).alias("w")) for a, b, w in kernel)))
    sent = df.where(F.col(code) >= 0).select(*by, y, x, code, steps.alias("k")).select(*by, (F.col(y) + F.col("k.dy")).alias(y), (F.col(x) + F.col("k.dx")).alias(x), code, F.col("k.w").alias("w"))
    shares = sent.groupBy(*by, y, x, code).agg(F.sum("w").alias("w")).groupBy(*by, y, x)
    best = shares.agg(F.max_by(code, F.struct(F.round("w", 9), -F.col(code))).alias("best"), F.round(F.max("w") / F.sum("w"), 9).alias("share"))
    out = F.when(F.col(code) >= 0, F.when(F.col("share") >= least, F.col("best")).otherwise(0)).otherwise(-1)
    return df.select(*by, y, x, code).join(best, [*by, y, x], "left").select(*by, y, x, out.alias("smooth"))


def haar(n: int) -> np.ndarray:
    """Orthonormal packet of n = 2^k neighbouring values: a row for each node of the level."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.vstack([np.kron(h, [1, 1]), np.kron(h, [1, -1])]) / np.sqrt(2)
    return h


def packet_energy(df: DataFrame, key: str, y: str, x: str, value: str, levels: int) -> DataFrame:
    """(key, level, node_y, node_x, energy): energy of each node of the two-dimensional Haar packets of a granule. Rows and columns beyond the
    last full block of 2^levels are left out and missing values are 0. A granule has a fixed size, so a group is bounded."""

    def transform(pdf):
        import pandas as pd

        block, r, c = 1 << levels, pdf[y].to_numpy(), pdf[x].to_numpy()
        field = np.zeros((r.max() + 1, c.max() + 1))
        field[r, c] = np.nan_to_num(pdf[value].to_numpy(dtype=float))
        field = field[: len(field) // block * block, : field.shape[1] // block * block]
        out = []
        for level in range(1, levels + 1):
            h, n = haar(1 << level), 1 << level
            blocks = field.reshape(len(field) // n, n, field.shape[1] // n, n)
            energy = (np.einsum("pi,aibj,qj->abpq", h, blocks, h) ** 2).sum(axis=(0, 1))
            p, q = np.mgrid[:n, :n]
            out.append(pd.DataFrame({key: pdf[key].iloc[0], "level": level, "node_y": p.ravel(), "node_x": q.ravel(), "energy": energy.ravel()}))
        return pd.concat(out)

    kind = dict(df.dtypes)[key]
    return df.select(key, y, x, value).groupBy(key).applyInPandas(transform, f"{key} {kind}, level int, node_y int, node_x int, energy double")


def track(df: DataFrame, by: list[str], order: str, lat: str, lon: str, step: float) -> DataFrame:
    """(by, row, lat, lon): a track at equal distances of `step` km, linear between its points; longitudes must not jump (see unroll). Each stretch
    between two points makes its own rows."""
    w = Window.partitionBy(*by).orderBy(order)
    apart = F.when(F.lag(lat).over(w).isNull(), 0.0).otherwise(great_circle(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)))
    far = df.select(*by, order, lat, lon, apart.alias("__d")).withColumn("__at", F.sum("__d").over(w))
    far = far.withColumns({"__to": F.lead("__at").over(w), "__lat": F.lead(lat).over(w), "__lon": F.lead(lon).over(w)}).where("__to > __at")
    first, last = F.ceil(F.col("__at") / step), F.ceil(F.col("__to") / step) - 1
    rows = far.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    part = (F.col("row") * step - F.col("__at")) / (F.col("__to") - F.col("__at"))
    return rows.select(*by, "row", (F.col(lat) + part * (F.col("__lat") - F.col(lat))).alias("lat"), (F.col(lon) + part * (F.col("__lon") - F.col(lon))).alias("lon"))


def swath_grid(centre: DataFrame, by: list[str], width: int, step: float, reach: int = 5) -> DataFrame:
    """(by, row, col, lat, lon): `width` tracks on either side of a track of equal distances, `step` km apart along the normals of the track, whose
    direction is taken between the rows `reach` before and after. Places on a sphere: cos(d) times the point plus sin(d) times the normal."""
    w = Window.partitionBy(*by).orderBy("row")
    phi, lam = F.radians("lat"), F.radians("lon")
    points = centre.select(*by, "row", (F.cos(phi) * F.cos(lam)).alias("p0"), (F.cos(phi) * F.sin(lam)).alias("p1"), F.sin(phi).alias("p2"))
    ends = {f"{k}{i}": F.first(f"p{i}").over(w.rowsBetween(-reach, 0)) if k == "a" else F.last(f"p{i}").over(w.rowsBetween(0, reach)) for k in "ab" for i in range(3)}
    points = points.withColumns(ends)
    p = tuple(F.col(f"p{i}") for i in range(3))
    normal = unit(cross(p, tuple(F.col(f"b{i}") - F.col(f"a{i}") for i in range(3))))
    points = points.withColumns({f"n{i}": c for i, c in enumerate(normal)}).withColumn("col", F.explode(F.sequence(F.lit(-width), F.lit(width))))
    d = F.col("col") * (-step / 6371.0)
    x, y, z = (F.cos(d) * F.col(f"p{i}") + F.sin(d) * F.col(f"n{i}") for i in range(3))
    return points.select(*by, "row", "col", F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))


def windows(df: DataFrame, by: str, y: str, x: str, value: str, size: int, least: float) -> DataFrame:
    """(by, y0, x0): square windows of a granule with at least the share `least` of valid values. A sweep goes on by a window after one that is
    taken and by a quarter of it otherwise, along each row and from row to row; each step depends on those before, so a granule, which has a
    bounded size, is one group."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        shape = int(pdf[y].max()) + 1, int(pdf[x].max()) + 1
        valid = np.zeros(shape, bool)
        valid[pdf[y], pdf[x]] = pdf[value].notna()
        sums = np.pad(valid.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        out, i = [], 0
        while i + size <= shape[0]:
            before, j = len(out), 0
            while j + size <= shape[1]:
                taken = sums[i + size, j + size] - sums[i, j + size] - sums[i + size, j] + sums[i, j] >= least * size * size
                if taken:
                    out.append((i, j))
                j += size if taken else max(1, size // 4)
            i += size if len(out) > before else max(1, size // 4)
        return pd.DataFrame({by: pdf[by].iloc[0], "y0": [o[0] for o in out], "x0": [o[1] for o in out]})

    return df.select(by, y, x, value).groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, y0 int, x0 int")
