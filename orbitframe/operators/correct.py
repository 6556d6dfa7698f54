"""Distribution matching: the shift that turns simulated into observed temperatures at equal cumulated frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.operators.sequence import cdf


def fit(observed: DataFrame, simulated: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """(by, order, delta): for each simulated bin the observed position of the same cumulated frequency, less its own. Observed positions
    between two bins are linear; groups that either side lacks have no correction. The least observed bin stands for all below it."""
    obs, sim = cdf(observed, by, order, n), cdf(simulated, by, order, n)
    w = Window.partitionBy(*by).orderBy(order)
    steps = obs.select(*by, F.col(order).cast("double").alias("hi"), F.col("cdf").alias("c1"), F.coalesce(F.lag(order).over(w), F.col(order)).cast("double").alias("lo"), F.coalesce(F.lag("cdf").over(w), F.lit(0.0)).alias("c0"))
    both = sim.join(steps, by).where((F.col("cdf") > F.col("c0")) & (F.col("cdf") <= F.col("c1")))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("cdf") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    return both.select(*by, order, (at - F.col(order)).alias("delta"))


def apply(df: DataFrame, table: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with the corrected value; 0 is added where the table has no row, and for snow and sea ice."""
    out = df.join(table, [*by, order], "left")
    skip = F.col("surface_type").isin(2, 8, 9, 10, 11, 16)
    return out.withColumn(value, F.col(value) + F.when(skip, 0.0).otherwise(F.coalesce("delta", F.lit(0.0)))).drop("delta")
