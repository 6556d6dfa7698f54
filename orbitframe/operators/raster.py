"""Filling of gaps in rasters from cells around them, in passes, on tiles with a halo.

A pass is a list of offsets: a cell without a value takes that of the first of these places that had one when the pass began. What a cell gets
depends on no cell farther off than the passes reach together, so a tile with a halo of that width is filled like the whole raster, and a tile is
a bounded group, however large the raster is."""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Passes = list[list[tuple[int, int]]]


def diagonal(reach: int = 9) -> Passes:
    """An advancing front along the diagonals: at each distance up to `reach` from the lower right, upper right, lower left and upper left, each of which
    sees what those before have filled."""
    return [[(dy * i, dx * i)] for i in range(1, reach + 1) for dy, dx in ((1, 1), (-1, 1), (1, -1), (-1, -1))]


def around(times: int = 4) -> Passes:
    """The eight neighbours, column by column, some times over."""
    return [[(dy, dx) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dy or dx]] * times


def fill_array(field: np.ndarray, passes: Passes, there: np.ndarray | None = None) -> np.ndarray:
    """The same of one array, whose gaps are NaN; beyond its edge, and where `there` is false, nothing is filled or taken."""
    for offsets in passes:
        before = field
        field = before.copy()
        for dy, dx in offsets:
            n, m = (max(0, k - abs(d)) for k, d in zip(field.shape, (dy, dx), strict=True))
            to = field[max(-dy, 0) :][:n, max(-dx, 0) :][:, :m]
            source = before[max(dy, 0) :][:n, max(dx, 0) :][:, :m]
            gaps = np.isnan(to)
            if there is not None:
                gaps &= there[max(-dy, 0) :][:n, max(-dx, 0) :][:, :m]
            to[gaps] = source[gaps]
    return field


def fill(df: DataFrame, by: list[str], y: str, x: str, value: str, passes: Passes, tile: int = 512) -> DataFrame:
    """Cells (by, y, x, value) with gaps filled; a gap is a null value of a cell that has a row; cells without a row are beyond the edge.

    A tile is at least twice as wide as its halo, so a cell is sent to four tiles at most, and only to tiles that have cells of their own. What a
    tile fills is no larger than the cells it was sent."""
    halo = [sum(max(abs(o[k]) for o in offsets) for offsets in passes) for k in (0, 1)]
    high, wide = (max(tile, 2 * h) for h in halo)

    def holding(c: str, reach: int, size: int, name: str) -> Column:
        at = F.col(c)
        return F.explode(F.sequence(F.floor((at - reach) / size), F.floor((at + reach) / size))).alias(name)

    cut = df.select(*by, y, x, F.col(value).cast("double").alias(value)).select("*", holding(y, halo[0], high, "__i")).select("*", holding(x, halo[1], wide, "__j"))
    own = df.select(*by, F.floor(F.col(y) / high).alias("__i"), F.floor(F.col(x) / wide).alias("__j")).distinct()
    same = functools.reduce(operator.and_, (cut[k].eqNullSafe(own[k]) for k in (*by, "__i", "__j")))
    kinds = dict(df.dtypes)

    def run(pdf):
        r, c = pdf[y].to_numpy(dtype=int), pdf[x].to_numpy(dtype=int)
        inside = (r // high == int(pdf["__i"].iloc[0])) & (c // wide == int(pdf["__j"].iloc[0]))
        r, c = r - r.min(), c - c.min()
        field = np.full((r.max() + 1, c.max() + 1), np.nan)
        field[r, c] = pdf[value].to_numpy(dtype=float, na_value=np.nan)
        there = np.zeros(field.shape, bool)
        there[r, c] = True
        done = fill_array(field, passes, there)[r, c]
        out = pdf.loc[inside, [*by, y, x]].copy()
        out[value] = [None if np.isnan(v) else v for v in done[inside]]
        return out

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*by, y, x)), f"{value} double"])
    return cut.join(own, same, "left_semi").groupBy(*by, "__i", "__j").applyInPandas(run, schema)
