"""What is reported of a distribution: mean, quantiles, probability of exceedance and one draw, of rows of quantiles or of binned densities.

Quantiles are those of levels i / (n + 1); the distribution is linear between them and constant in the tails. Densities are logits of bins with
given edges, uniform inside a bin. A draw is the quantile at a level that a hash of the row's key gives, so that reruns agree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TERCILES, RAIN = (1 / 3, 2 / 3), 1e-4


def level_of(key: Column, seed: int = 1) -> Column:
    """A number between 0 and 1 that follows from an integer key."""
    place = (F.pmod(key.cast("long"), F.lit(2147483647)) * 1103515245 + F.lit(seed) * 12345) % 2147483647
    return (place + 0.5) / 2147483647.0


def levels(n: int) -> np.ndarray:
    return np.arange(1, n + 1) / (n + 1)


def mean_weights(n: int) -> np.ndarray:
    """Of sorted quantiles in their mean: trapezoids between the levels, tails constant."""
    at = levels(n)
    steps = np.diff(at)
    w = np.zeros(n)
    w[:-1] += steps / 2
    w[1:] += steps / 2
    w[0] += at[0]
    w[-1] += 1 - at[-1]
    return w


def quantile_at(q: np.ndarray, level: np.ndarray | float) -> np.ndarray:
    """Of each row of sorted quantiles the quantile at a level, one for all or one a row."""
    n = q.shape[1]
    at = np.clip(np.broadcast_to(level, len(q)) * (n + 1) - 1, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    rows, part = np.arange(len(q)), at - low
    return q[rows, low] * (1 - part) + q[rows, np.minimum(low + 1, n - 1)] * part


def exceedance(q: np.ndarray, y: float) -> np.ndarray:
    """P(value > y) of each row of sorted quantiles."""
    n = q.shape[1]
    at, k, rows = levels(n), (q <= y).sum(axis=1), np.arange(len(q))
    low, high = np.clip(k - 1, 0, n - 1), np.clip(k, 0, n - 1)
    a, b = q[rows, low], q[rows, high]
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = 1 - (at[low] + (at[high] - at[low]) * (y - a) / (b - a))
    return np.where(k == 0, 1 - at[0], np.where(k == n, 1 - at[-1], inside))


def of_quantiles(q: np.ndarray, draw: np.ndarray) -> dict[str, np.ndarray]:
    q = np.sort(np.asarray(q, float), axis=1)
    first, second = (quantile_at(q, t) for t in TERCILES)
    return {"mean": q @ mean_weights(q.shape[1]), "tercile_1": first, "tercile_2": second, "pop": exceedance(q, RAIN), "sample": quantile_at(q, draw)}


def of_density(logits: np.ndarray, edges: np.ndarray, draw: np.ndarray) -> dict[str, np.ndarray]:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = p / p.sum(axis=1, keepdims=True)
    upto = np.concatenate((np.zeros((len(p), 1)), np.cumsum(p, axis=1)), axis=1)
    upto[:, -1] = 1
    rows = np.arange(len(p))

    def at(level: np.ndarray | float) -> np.ndarray:
        u = np.broadcast_to(level, len(p))
        k = np.clip((upto <= u[:, None]).sum(axis=1) - 1, 0, p.shape[1] - 1)
        share = np.divide(u - upto[rows, k], p[rows, k], out=np.zeros(len(p)), where=p[rows, k] > 0)
        return edges[k] + np.clip(share, 0, 1) * (edges[k + 1] - edges[k])

    k = int(np.clip(np.searchsorted(edges, RAIN, side="right") - 1, 0, p.shape[1] - 1))
    inside = np.clip((RAIN - edges[k]) / (edges[k + 1] - edges[k]), 0, 1)
    first, second = (at(t) for t in TERCILES)
    return {"mean": p @ ((edges[1:] + edges[:-1]) / 2), "tercile_1": first, "tercile_2": second, "pop": 1 - upto[:, k] - inside * p[:, k], "sample": at(draw)}
