"""Histogram bins as expressions on literal edges, so that they stay in generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_edges(low: float, high: float, n: int) -> list[float]:
    return [float(x) for x in np.linspace(low, high, n + 1)]


def log_edges(low: float, high: float, n: int) -> list[float]:
    return [float(x) for x in np.logspace(np.log10(low), np.log10(high), n + 1)]


def uniform_bin(c: Column, low: float, high: float, n: int) -> Column:
    """Bin of `n` equal ones, [a, b) and the last closed; null outside. For bounds and widths that doubles hold exactly."""
    width = (high - low) / n
    return F.when((c >= low) & (c < high), F.floor((c - low) / width)).when(c == high, n - 1).cast("int")


def log_bin(c: Column, low: float, high: float, n: int) -> Column:
    """Bin of `n` equal ones in log10, [a, b) and the last closed; null outside and for values that are not positive."""
    x = (F.log10(F.when(c > 0, c)) - float(np.log10(low))) * n / float(np.log10(high) - np.log10(low))
    return F.when((c >= low) & (c <= high), F.least(F.floor(F.round(x, 9)), F.lit(n - 1))).cast("int")


def edge_bin(c: Column, edges: list[float]) -> Column:
    """Bin between arbitrary ascending edges, by the number of edges at or below the value."""
    below = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= c)) - 1
    return F.when((c >= edges[0]) & (c < edges[-1]), below).when(c == edges[-1], len(edges) - 2).cast("int")


def digitize(c: Column, edges: list[float]) -> Column:
    """0 below the first edge, len(edges) at or above the last; nothing is dropped."""
    return F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= c))
