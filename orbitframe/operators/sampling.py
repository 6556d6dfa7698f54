"""Draws, resampling, ablation and augmentation. A draw is a function of a row's key and a seed, so reruns and lost tasks give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Draw = Callable[[Column, int], Column]


def hashed(key: Column, seed: int) -> Column:
    """Uniform in (0, 1) from a hash of the key."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def arithmetic(key: Column, seed: int) -> Column:
    """Uniform in (0, 1) in integer arithmetic, which any engine repeats; for small tables and tests."""
    return (((key * 7919 + seed * 104729) % 100003).cast("double") + 0.5) / 100003.0


def normal(key: Column, seed: int, draw: Draw = hashed) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.log(draw(key, seed))) * F.cos(2 * math.pi * draw(key, seed + 1))


def noise(tb: Column, nedt: list[float], key: Column, seed: int, draw: Draw = hashed) -> Column:
    """Channels with thermal noise of the given deviations; each channel has its own draw."""
    drawn = F.array(*(normal(key, seed + 2 * k, draw) * s for k, s in enumerate(nedt)))
    return F.zip_with(tb, drawn, lambda t, e: t + e)


def dropout(tb: Column, share: float, key: Column, seed: int, draw: Draw = hashed) -> Column:
    """Channels of which each is null with the given probability."""
    return F.transform(tb, lambda t, i: F.when(draw(key * 64 + i, seed) >= share, t))


def mask_edges(value: Column, pixel: Column, n_pixels: int, most: int, key: Column, seed: int, draw: Draw = hashed) -> Column:
    """Null in as many edge pixels, left or right, as the scene's draw says: up to `most`."""
    width = F.floor(draw(key, seed) * (most + 1))
    left = draw(key, seed + 1) < 0.5
    return F.when(~F.when(left, pixel < width).otherwise(pixel >= n_pixels - width), value)


def replace_zeros(value: Column, threshold: float, key: Column, seed: int, draw: Draw = hashed) -> Column:
    """Values of at most the threshold become log-uniform within four decades below it, so that logarithms exist."""
    low = math.log10(threshold) - 4
    return F.when(F.abs(value) <= threshold, F.pow(F.lit(10.0), low + 4 * draw(key, seed))).otherwise(value)


def ablate(features: Column, drop: list[int]) -> Column:
    """Features with the places of `drop` null."""
    return F.transform(features, lambda x, i: F.when(~i.isin(drop), x)) if drop else features


def permute(df: DataFrame, by: list[str], key: str, column: str, seed: int, draw: Draw = hashed) -> DataFrame:
    """The column's values are dealt anew within each group: a row gets the value of the next one in the order of a draw, the last that of the
    first. A group is a granule, which has a bounded size."""
    w = Window.partitionBy(*by).orderBy(draw(F.col(key), seed), F.col(key))
    value = F.struct(F.col(column).alias("v"))  # the value of the next row may be null, that there is none may not
    after = F.coalesce(F.lead(value).over(w), F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("__n", after).withColumn(column, F.col("__n.v")).drop("__n")


def resample(weights: DataFrame, by: list[str], order: str, weight: str, n: int, key: Column, seed: int = 1, draw: Draw = hashed) -> DataFrame:
    """(by, order, draw) of n draws with replacement from each group's rows, with chances as their weights; none if the weights sum to 0. A group's
    running sums of weights meet its draws in an equi-join on the group."""
    w = Window.partitionBy(*by).orderBy(order)
    bands = weights.withColumns({"__hi": F.sum(weight).over(w), "__all": F.sum(weight).over(Window.partitionBy(*by))}).withColumn("__lo", F.col("__hi") - F.col(weight)).where(F.col("__all") > 0)
    draws = weights.select(*by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("__u", draw(key * n + F.col("draw"), seed))
    at = F.col("__u") * F.col("__all")
    return bands.join(draws, by).where((at >= F.col("__lo")) & (at < F.col("__hi"))).select(*by, order, "draw")


def flips(scan: Column, pixel: Column, n_scans: int, n_pixels: int, scene: Column, seed: int, draw: Draw = hashed) -> tuple[Column, Column]:
    """Scan and pixel of a scene that is turned over along and across the track by its draws."""
    return F.when(draw(scene, seed) < 0.5, n_scans - 1 - scan).otherwise(scan), F.when(draw(scene, seed + 1) < 0.5, n_pixels - 1 - pixel).otherwise(pixel)


def scenes(df: DataFrame, by: str, y: str, x: str, value: str, size: int, least: int, seed: int = 1) -> DataFrame:
    """(by, scene, y0, x0): windows of size x size around valid pixels that no earlier window covers, drawn in a fixed order; a window is moved
    inside the swath and kept if it has more than `least` valid values. Each choice depends on those before, so a granule, which has a bounded
    size, is one group."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        ny, nx = int(pdf[y].max()) + 1, int(pdf[x].max()) + 1
        field = np.full((ny, nx), np.nan)
        field[pdf[y], pdf[x]] = pdf[value].to_numpy(float)
        valid, covered, out = np.isfinite(field), np.zeros((ny, nx), bool), []
        ys, xs = np.nonzero(valid)
        for k in np.random.default_rng([seed, int(pdf[by].iloc[0])]).permutation(len(ys)):
            if covered[ys[k], xs[k]]:
                continue
            y0, x0 = (int(np.clip(c - size // 2, 0, max(0, n - size))) for c, n in ((ys[k], ny), (xs[k], nx)))
            window = np.s_[y0 : y0 + size, x0 : x0 + size]
            covered[window] = True
            if valid[window].sum() > least:
                out.append((len(out), y0, x0))
        return pd.DataFrame({by: pdf[by].iloc[0], "scene": [o[0] for o in out], "y0": [o[1] for o in out], "x0": [o[2] for o in out]})

    return df.select(by, y, x, value).groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, scene int, y0 int, x0 int")
