"""Scoring of scenes in overlapping tiles of both axes: cut, convolve, blend.

Tiles begin every tile - overlap rows and columns; the last one of an axis ends with the data. Weights of neighbouring tiles ramp linearly over
the overlap, from 0 to 1 and from 1 to 0, and add up to 1 everywhere. A tile is one bounded group, so memory depends on neither the scene nor the
table; a pixel travels once for each tile that holds it (four at most, but for the last of an axis) and its answers once more to be summed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts_of(n: Column, tile: int, overlap: int) -> Column:
    """First places of the tiles of an axis of length n."""
    last = F.greatest(n - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(tile - overlap).cast("long")), F.array(last)))


def ramp(starts: list[int], k: int, tile: int, overlap: int) -> np.ndarray:
    """Weights of the k-th tile's places along one axis. A ramp begins where the tile before the last has ended, and is as long as the two share, the
    overlap at most."""
    place, own = np.arange(tile, dtype=float), starts[k]

    def begin(a: int) -> tuple[int, int]:
        """Where tile a begins to replace the tile before it, and over how many places."""
        at = max(starts[a], starts[a - 2] + tile) if a > 1 else starts[a]
        return at, max(0, min(starts[a - 1] + tile - at, overlap))

    weight = np.ones(tile)
    for a, rising in ((k, True), (k + 1, False)):
        if 0 < a < len(starts):
            at, length = begin(a)
            step = (place - (at - own)) / max(length - 1, 1) if length else (place >= at - own).astype(float)
            weight *= np.clip(step if rising else 1 - step, 0, 1)
    return weight


def convolve(field: np.ndarray, layers: list[dict[str, np.ndarray]]) -> np.ndarray:
    """(channels, rows, columns) through convolutions with zeros beyond the edge, ReLU between them. A layer has w (out, in, height, width), may have b
    (out), and may repeat rows (`rows` times) for answers on a finer grid."""
    for k, layer in enumerate(layers):
        w = layer["w"]
        a, b = w.shape[2] // 2, w.shape[3] // 2
        padded = np.pad(field, ((0, 0), (a, w.shape[2] - 1 - a), (b, w.shape[3] - 1 - b)))
        views = np.lib.stride_tricks.sliding_window_view(padded, w.shape[2:], axis=(1, 2))
        field = np.einsum("cyxij,ocij->oyx", views, w, optimize=True) + layer.get("b", np.zeros(len(w)))[:, None, None]
        if k < len(layers) - 1:
            field = np.maximum(field, 0)
        field = np.repeat(field, layer.get("rows", 1), axis=1)
    return field


def score(df: DataFrame, by: list[str], y: str, x: str, values: list[str], layers: list[dict[str, np.ndarray]], out: list[str], tile: tuple[int, int], overlap: tuple[int, int], missing: float = -1.5) -> DataFrame:
    """(by, y, x, out): answers of a convolutional network for scenes of pixels (by, y, x, values), each scored in tiles and blended. Null and absent
    pixels are `missing`. Rows of layers with `rows` are numbered on the finer grid."""
    shared = df.sparkSession.sparkContext.broadcast(layers)  # a model's size
    factor = int(np.prod([layer.get("rows", 1) for layer in layers]))
    size = df.groupBy(*by).agg((F.max(y) + 1).cast("long").alias("__n"), (F.max(x) + 1).cast("long").alias("__m"))
    size = size.select(*by, "__n", "__m", starts_of(F.col("__n"), tile[0], overlap[0]).alias("__ys"), starts_of(F.col("__m"), tile[1], overlap[1]).alias("__xs"))

    def holding(starts: str, at: str, length: int, name: str) -> Column:
        inside = F.transform(starts, lambda s, k: F.when((F.col(at) >= s) & (F.col(at) < s + length), k))
        return F.explode(F.array_compact(inside)).alias(name)

    cut = df.select(*by, y, x, *values).join(size, by).select("*", holding("__ys", y, tile[0], "__i")).select("*", holding("__xs", x, tile[1], "__j"))

    def run(pdf):
        import pandas as pd

        first = pdf.iloc[0]
        ys, xs, i, j = list(first["__ys"]), list(first["__xs"]), int(first["__i"]), int(first["__j"])
        h, w = min(tile[0], int(first["__n"])), min(tile[1], int(first["__m"]))
        field = np.full((len(values), h, w), missing)
        at = (pdf[y].to_numpy(dtype=int) - ys[i], pdf[x].to_numpy(dtype=int) - xs[j])
        for c, name in enumerate(values):
            field[c][at] = pdf[name].to_numpy(dtype=float, na_value=np.nan)
        answer = convolve(np.nan_to_num(field, nan=missing), shared.value)
        weight = np.outer(ramp([s * factor for s in ys], i, h * factor, overlap[0] * factor), ramp(xs, j, w, overlap[1]))
        r, c = np.nonzero(weight)
        found = {k: first[k] for k in by} | {y: r + ys[i] * factor, x: c + xs[j]} | {name: answer[k][r, c] * weight[r, c] for k, name in enumerate(out)}
        return pd.DataFrame(found)

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"{y} long", f"{x} long", *(f"{k} double" for k in out)])
    parts = cut.groupBy(*by, "__i", "__j").applyInPandas(run, schema)
    return parts.groupBy(*by, y, x).agg(*(F.sum(k).alias(k) for k in out))
