"""Stencils on (row, column) grids, and spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gaussian(radius: int, sigma: float) -> list[tuple[int, int, float]]:
    """(dy, dx, weight) of a square kernel."""
    span = range(-radius, radius + 1)
    return [(dy, dx, math.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))) for dy in span for dx in span]


def smooth(df: DataFrame, by: list[str], y: str, x: str, value: str, kernel: list[tuple[int, int, float]], least: float, total: bool = False) -> DataFrame:
    """(by, y, x, smooth): weighted mean (or sum, if total) of the valid values under the kernel; null where their weight is not above `least`. Rows are dealt to
    the places they reach and combined before the shuffle."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(w).alias("w")) for a, b, w in kernel)))
    sent = df.where(F.col(value).isNotNull()).select(*by, y, x, value, steps.alias("k")).select(*by, (F.col(y) + F.col("k.dy")).alias(y), (F.col(x) + F.col("k.dx")).alias(x), (F.col("k.w") * F.col(value)).alias("wv"), F.col("k.w").alias("w"))
    sums = sent.groupBy(*by, y, x).agg(F.sum("wv").alias("wv"), F.sum("w").alias("w"))
    return sums.select(*by, y, x, F.when(F.col("w") > least, F.col("wv") if total else F.col("wv") / F.col("w")).alias("smooth"))


def pad(df: DataFrame, by: list[str], y: str, x: str, shape: tuple[int, int], multiple: int) -> DataFrame:
    """Fields of a fixed shape, extended on both sides to multiples; new places, some of them negative, repeat the edge. Each row on an edge is dealt
    to the places beyond it, so nothing is joined."""

    def places(c: str, n: int) -> Column:
        more = -n % multiple
        low, high = -(more // 2), n + more - more // 2 - 1
        first = F.when(F.col(c) == 0, F.lit(low)).otherwise(F.col(c))
        return F.explode(F.sequence(first, F.when(F.col(c) == n - 1, F.lit(high)).otherwise(F.col(c))))

    rest = [c for c in df.columns if c not in (*by, y, x)]
    out = df.select(*by, places(y, shape[0]).alias(y), x, *rest)
    return out.select(*by, y, places(x, shape[1]).alias(x), *rest)


def dilate(df: DataFrame, by: list[str], y: str, x: str, radius: int) -> DataFrame:
    """Places within a square of the given places."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    out = df.select(*by, y, x, F.explode(span).alias("dy")).select(*by, (F.col(y) + F.col("dy")).alias(y), x, F.explode(span).alias("dx"))
    return out.select(*by, y, (F.col(x) + F.col("dx")).alias(x)).distinct()


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, i = np.mgrid[:n, :n]
    c = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    c[0] /= np.sqrt(2)
    return c


def spectra(df: DataFrame, key: str, y: str, x: str, value: str, reference: str) -> DataFrame:
    """(scale, energy, energy_ref, coherence, correlation, mse, efficiency, n): cosine spectra of both fields over the granules, in radial bins, and
    how well the first gives the second at each scale (efficiency after Nash and Sutcliffe, of four coefficients at least). A granule has a
    fixed size, so a group is bounded; missing values count as 0."""

    def transform(pdf):
        import pandas as pd

        r, c = pdf[y].to_numpy(), pdf[x].to_numpy()
        fields = []
        for name in (value, reference):
            field = np.zeros((r.max() + 1, c.max() + 1))
            field[r, c] = np.nan_to_num(pdf[name].to_numpy(dtype=float))
            fields.append(dct_matrix(len(field)) @ field @ dct_matrix(field.shape[1]).T)
        ky, kx = np.mgrid[: fields[0].shape[0], : fields[0].shape[1]]
        scale = np.floor(np.hypot(ky / fields[0].shape[0], kx / fields[0].shape[1]) * 32).astype(int).ravel()
        return pd.DataFrame({"scale": scale, "a": fields[0].ravel(), "b": fields[1].ravel()})

    rows = df.select(key, y, x, value, reference).groupBy(key).applyInPandas(transform, "scale int, a double, b double")
    d = F.col("a") - F.col("b")
    sums = rows.groupBy("scale").agg(F.sum(F.col("a") ** 2).alias("energy"), F.sum(F.col("b") ** 2).alias("energy_ref"), F.sum(F.col("a") * F.col("b")).alias("cross"), F.sum(d * d).alias("squares"), F.sum("b").alias("sum_ref"), F.count("*").alias("n"))
    spread = F.col("energy_ref") - F.col("sum_ref") ** 2 / F.col("n")
    efficiency = F.when(F.col("n") >= 4, 1 - F.try_divide("squares", spread))
    correlation = F.try_divide("cross", F.sqrt(F.col("energy") * F.col("energy_ref")))
    return sums.select("scale", "energy", "energy_ref", F.abs(correlation).alias("coherence"), correlation.alias("correlation"), (F.col("squares") / F.col("n")).alias("mse"), efficiency.alias("efficiency"), "n")
