"""Mergeable statistics: a statistic is keys and additive measures, so partial tables add up by one more grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partial(df: DataFrame, keys: dict[str, Column], value: Column | None = None) -> DataFrame:
    """(keys, n, total) over rows whose keys and value are not null."""
    cols = [c.alias(k) for k, c in keys.items()]
    if value is None:
        return df.select(*cols).dropna().groupBy(*keys).agg(F.count("*").alias("n"))
    return df.select(*cols, value.cast("double").alias("__v")).dropna().groupBy(*keys).agg(F.count("*").alias("n"), F.sum("__v").alias("total"))


def merge(*parts: DataFrame) -> DataFrame:
    """Sum of partial tables with the same keys."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    measures = [c for c in ("n", "total") if c in out.columns]
    return out.groupBy(*(c for c in out.columns if c not in measures)).agg(*(F.sum(c).alias(c) for c in measures))


def finish(stat: DataFrame) -> DataFrame:
    """With the mean of each cell; null where it is empty."""
    return stat.withColumn("mean", F.try_divide("total", F.col("n").cast("double")))


def scan_position_mean(df: DataFrame, value: str, skipna: bool = False) -> DataFrame:
    """Mean by pixel position. Missing values count as 0 unless skipna."""
    v = F.col(value) if skipna else F.coalesce(F.col(value), F.lit(0.0))
    return df.groupBy("pixel").agg(F.avg(v).alias("mean"), F.count("*").alias("n"))


def dense(stat: DataFrame, key: str, n: int) -> DataFrame:
    """All bins 0 to n - 1 of one key, with 0 where a bin has no row."""
    grid = stat.sparkSession.range(n).select(F.col("id").cast("int").alias(key))
    return grid.join(stat, key, "left").fillna(0)


def unpivot_targets(df: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """(keys, target, value): one row a target, so that one grouping serves all targets."""
    return df.unpivot(keys, targets, "target", "value")


def bundle(df: DataFrame, statistics: dict[str, list[Column]], value: Column) -> DataFrame:
    """(statistic, k0, k1, ..., n, total): several statistics of one value in a single scan. A row is a key of each statistic, and partial sums are
    made before anything is shuffled; keys are whole numbers, and shorter keys end in nulls. Rows with a null among their keys or a null
    value take no part in a statistic."""
    most = max(len(keys) for keys in statistics.values())
    each = F.array(*(F.struct(F.lit(name).alias("statistic"), *(k.cast("int").alias(f"k{i}") for i, k in enumerate(keys)), *(F.lit(None).cast("int").alias(f"k{i}") for i in range(len(keys), most))) for name, keys in statistics.items()))
    rows = df.where(value.isNotNull()).select(value.cast("double").alias("__v"), F.explode(each).alias("s")).select("s.*", "__v")
    whole = F.lit(True)
    for i in range(most):
        shorter = [name for name, keys in statistics.items() if len(keys) <= i]
        whole = whole & (F.col(f"k{i}").isNotNull() | F.col("statistic").isin(shorter))
    return rows.where(whole).groupBy("statistic", *(f"k{i}" for i in range(most))).agg(F.count("*").alias("n"), F.sum("__v").alias("total"))
