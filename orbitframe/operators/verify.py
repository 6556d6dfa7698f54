"""Verification of retrieved against reference rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions.bins import log_bin, uniform_bin
from orbitframe.functions.clean import valid
from orbitframe.sources import store


def _sp() -> Column:
    return F.col("surface_precip")


def _ref() -> Column:
    return F.col("surface_precip_ref")


def correlation() -> Column:
    """Pearson's correlation; null where either side does not vary."""
    return F.try_divide(F.covar_pop(_sp(), _ref()), F.stddev_pop(_sp()) * F.stddev_pop(_ref()))


def error_metrics(df: DataFrame, by: list[str], rqi: float = 0.2, **options) -> DataFrame:
    """Bias (percent), MAE, MSE, correlation, SMAPE (reference above 0.1) and number by group."""
    df = df.where(valid(rqi=rqi, **options))
    d = _sp() - _ref()
    smape = F.when(_ref() > 0.1, 100 * F.abs(d) / (0.5 * (F.abs(_sp()) + F.abs(_ref()))))
    return df.groupBy(*by).agg(
        F.try_divide(F.avg(d) * 100, F.avg(_ref())).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), correlation().alias("correlation"), F.avg(smape).alias("smape"), F.count("*").alias("n")
    )


def type_contribution(df: DataFrame, types: dict[str, list[int]], absolute: bool = False) -> DataFrame:
    """Share of the reference rain of each precipitation type; absolute: times the mean reference rate."""
    kept = df.where(valid(no_sea_ice=False))
    rain = F.sum(F.when(F.col("mask") > 0, _ref()))
    scale = F.avg(_ref()) if absolute else F.lit(1.0)
    wide = kept.agg(*((F.try_divide(F.sum(F.when(F.col("mask").isin(*v), _ref())), rain) * scale).alias(k) for k, v in types.items()))
    return wide.unpivot([], list(types), "precip_type", "contribution")


def conditional_pdf(df: DataFrame, low: float = 0.01, high: float = 100.0, n: int = 100) -> DataFrame:
    """Density of the retrieved rate given the reference bin, on log bins."""
    kept = df.where(valid()).select(log_bin(_ref(), low, high, n).alias("ref_bin"), log_bin(_sp(), low, high, n).alias("bin")).dropna()
    counts = kept.groupBy("ref_bin", "bin").agg(F.count("*").alias("n"))
    ratio = (high / low) ** (1 / n)
    width = F.lit(low) * (F.pow(F.lit(ratio), F.col("bin") + 1) - F.pow(F.lit(ratio), F.col("bin")))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("ref_bin")) / width)


def conditional_mean(df: DataFrame, low: float = 0.01, high: float = 100.0, n: int = 100) -> DataFrame:
    return df.where(valid()).groupBy(log_bin(_ref(), low, high, n).alias("ref_bin")).agg(F.avg(_sp()).alias("mean"), F.count("*").alias("n")).where("ref_bin is not null")


def explained_error(df: DataFrame, other: Column, by: list[str]) -> DataFrame:
    """Squared correlation of a retrieval's error with the error of another estimate of the same pixels."""
    return df.where(valid(no_sea_ice=False, no_snow=True, frozen=(3, 4), rqi=0.2) & (other >= 0)).groupBy(*by).agg(F.regr_r2(_sp() - _ref(), other - _ref()).alias("r2"), F.count("*").alias("n"))


def monthly_statistics(df: DataFrame) -> DataFrame:
    month = F.month("scan_time").alias("month")
    return df.where(valid(no_sea_ice=False, no_snow=True, no_orographic=True, frozen=(3, 4, 7))).groupBy(month).agg(F.avg(_ref() - _sp()).alias("bias"), correlation().alias("correlation"), F.count("*").alias("n"))


def smoothed_cycle(cycle: DataFrame, key: str, values: list[str], period: int, half: int, first: int = 0) -> DataFrame:
    """The phases of a cycle with their values and circular averages of each: every phase goes once to all whose average it is part of."""
    shifted = cycle.select(F.explode(F.array(*(F.lit(k) for k in range(-half, half + 1)))).alias("k"), key, *values)
    phase = (F.pmod(F.col(key) + F.col("k") - first, F.lit(period)) + first).cast("int")
    own = F.col("k") == 0
    met = shifted.groupBy(phase.alias(key)).agg(
        F.count_if(own).alias("__own"), *(F.max(F.when(own, F.col(v))).alias(v) for v in values), *(F.avg(v).alias(f"{v}_smooth") for v in values)
    )
    return met.where("__own > 0").drop("__own")


def seasonal_cycle(df: DataFrame) -> DataFrame:
    """Mean rates by month, and their three-month circular averages."""
    mean = df.where(valid(no_sea_ice=False, frozen=(3, 4, 7))).groupBy(F.month("scan_time").alias("month")).agg(F.avg(_sp()).alias("sp"), F.avg(_ref()).alias("ref"))
    return smoothed_cycle(mean, "month", ["sp", "ref"], 12, 1, 1)


def diurnal_cycle(df: DataFrame) -> DataFrame:
    """Mean rates by local hour and their seven-hour circular averages."""
    hour = F.hour(F.expr("timestampadd(SECOND, cast(longitude * 240 as int), scan_time)")).alias("hour")
    mean = df.where(valid(no_sea_ice=False, frozen=(3, 4, 7))).groupBy(hour).agg(F.avg(_sp()).alias("sp"), F.avg(_ref()).alias("ref"))
    return smoothed_cycle(mean, "hour", ["sp", "ref"], 24, 3)


def gridded(df: DataFrame, step: float = 20.0, least: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Bias, MAE, MSE and correlation by cell; null with fewer than `least` rows."""
    d = _sp() - _ref()
    cell = df.where(valid(frozen=(3, 4, 7))).groupBy(*by, uniform_bin(F.col("longitude"), -180.0, 180.0, int(360 / step)).alias("lon_bin"), uniform_bin(F.col("latitude"), -90.0, 90.0, int(180 / step)).alias("lat_bin"))
    out = cell.agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), correlation().alias("correlation"))
    return out.select(*by, "lon_bin", "lat_bin", "n", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("bias", "mae", "mse", "correlation")))


def pr_curve(df: DataFrame, score: Column, cut: float = 1e-4) -> DataFrame:
    """Precision and recall at every threshold. Scores are counted, into a staged table that is scanned for the ranges' edges and for the sums; sums run
    inside a range, those before it are added."""
    counts = df.where(valid(frozen=(3, 4, 7))).groupBy(score.alias("threshold")).agg(F.count_if(_ref() > cut).alias("hits"), F.count("*").alias("n"))
    path = store.workspace(df.sparkSession, "counts")
    counts.write.parquet(path)
    counts = df.sparkSession.read.schema(counts.schema).parquet(path)
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    edges = counts.select(F.col("threshold").cast("double").alias("x")).approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    above = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)).cast("array<double>"), lambda e: e > F.col("threshold")))
    counts = counts.withColumn("p", F.when(F.col("threshold").isNull(), len(edges)).otherwise(above))
    line, down = Window.orderBy("p"), Window.partitionBy("p").orderBy(F.desc("threshold"))  # line: one row a range
    before = counts.groupBy("p").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    before = before.select("p", (F.sum("hits").over(line) - F.col("hits")).alias("hits_before"), (F.sum("n").over(line) - F.col("n")).alias("n_before"), F.sum("hits").over(Window.partitionBy()).alias("all_hits"))
    run = counts.select("p", "threshold", F.sum("hits").over(down).alias("tp"), F.sum("n").over(down).alias("flagged")).join(F.broadcast(before), "p")
    tp, flagged = F.col("tp") + F.col("hits_before"), F.col("flagged") + F.col("n_before")
    return run.select("threshold", F.try_divide(tp, flagged).alias("precision"), F.try_divide(tp, F.col("all_hits")).alias("recall"))


def detection(df: DataFrame, by: list[str], cut: float = 1.0) -> DataFrame:
    flag = _sp() > cut
    return df.where(valid()).groupBy(*by).agg(F.try_divide(F.count_if((_ref() > 0) & flag), F.count_if(flag)).alias("precision"), F.try_divide(F.count_if((_ref() <= 1e-4) & flag), F.count_if(flag)).alias("far"), F.avg(_sp() - _ref()).alias("bias"))


def error_by_rate(df: DataFrame, low: float = 0.05, high: float = 150.0, n: int = 30) -> DataFrame:
    d = _sp() - _ref()
    sym = F.when(_ref() > 0.1, F.abs(d) / (0.5 * (_sp() + _ref())))
    return df.where(valid()).groupBy(log_bin(_ref(), low, high, n).alias("ref_bin")).agg(F.sum(d * d).alias("squared"), F.sum(F.abs(d)).alias("absolute"), F.sum(sym).alias("symmetric")).where("ref_bin is not null")


def bootstrap_mean(df: DataFrame, value: Column, key: Column, n: int = 20) -> DataFrame:
    """Mean and spread of the means of n resamples; row weights of 0 to 3 come from an integer hash of the key."""
    draws = df.where(value.isNotNull()).select(value.alias("x"), key.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    w = (F.col("k") * 1103515245 + F.col("draw") * 12345 + (F.col("k") * F.col("draw")) % 97) % 4
    means = draws.groupBy("draw").agg(F.try_divide(F.sum(w * F.col("x")), F.sum(w)).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


def poisson(u: Column) -> Column:
    """Poisson count of mean 1 at a uniform draw: how often a row stands in a resample. Above 5 (once in 1700 rows) counts as 6."""
    import math

    out, total = F.when(F.lit(False), 0), 0.0
    for k in range(6):
        total += 1 / math.factorial(k)
        out = out.when(u < total * math.exp(-1), k)
    return out.otherwise(6)


def poisson_bootstrap(df: DataFrame, value: str, key: Column, n: int, seed: int, draw) -> DataFrame:
    """(mean, std) of the means of n resamples, in one pass: each resample is a pair of sums with Poisson weights from a draw on the key."""
    weights = [poisson(draw(key, seed + k)) for k in range(n)]
    means = df.agg(F.array(*(F.sum(w * F.col(value)) / F.sum(w) for w in weights)).alias("m")).select(F.explode("m").alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
