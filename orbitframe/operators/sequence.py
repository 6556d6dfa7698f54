"""Operators along scans, levels and bins: gaps, filling, resampling, running sums, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cdf(df: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    whole, run = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    return df.withColumn("cdf", F.sum(n).over(run) / F.sum(n).over(whole))


def islands(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Runs of consecutive numbers: first, last and length of each."""
    run = F.col(order) - F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.select(*by, order).distinct().withColumn("run", run).groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def first_run(df: DataFrame, by: list[str], order: str, inclusive: bool = False) -> DataFrame:
    """The first run of consecutive numbers; its last number is left out unless inclusive."""
    runs = islands(df, by, order).groupBy(*by).agg(F.min_by(F.struct("first", "last"), "first").alias("r"))
    return runs.select(*by, F.col("r.first").alias("first"), (F.col("r.last") - (0 if inclusive else 1)).alias("last"))


def fill_nearest(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Null values take that of the nearest number that has one, the lower one in a tie."""
    w = Window.partitionBy(*by).orderBy(order)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("k"), F.col(value).alias("v")))
    before, after = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"__b": before, "__a": after})
    near = F.when(F.col("__a").isNull() | (F.col(order) - F.col("__b.k") <= F.col("__a.k") - F.col(order)), F.col("__b.v")).otherwise(F.col("__a.v"))
    return df.withColumn("filled", near).drop("__a", "__b")


def fill_linear(df: DataFrame, by: list[str], order: str, value: str, limit: int) -> DataFrame:
    """Linear between neighbours that are at most `limit` apart."""
    w = Window.partitionBy(*by).orderBy(order)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("k"), F.col(value).alias("v")))
    df = df.withColumns({"__b": F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__a": F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    gap = F.col("__a.k") - F.col("__b.k")
    line = F.col("__b.v") + (F.col("__a.v") - F.col("__b.v")) * (F.col(order) - F.col("__b.k")) / gap
    return df.withColumn("filled", F.coalesce(F.col(value), F.when(gap <= limit, line))).drop("__a", "__b")


def upsample(df: DataFrame, by: list[str], order: str, value: str, factor: int = 3) -> DataFrame:
    """Linear values at every 1 / factor of the order; nothing after the last row."""
    nxt = F.lead(value).over(Window.partitionBy(*by).orderBy(order))
    out = df.select(*by, order, value, nxt.alias("__n")).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).where((F.col("__k") == 0) | F.col("__n").isNotNull())
    return out.select(*by, (F.col(order) * factor + F.col("__k")).alias("fine"), F.when(F.col("__k") == 0, F.col(value)).otherwise(F.col(value) + (F.col("__n") - F.col(value)) * F.col("__k") / factor).alias(value))


def along_distance(df: DataFrame, by: list[str], order: str, step: Column) -> DataFrame:
    """Distance from the first row: running sum of `step`, the distance to the row before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__s", F.coalesce(step, F.lit(0.0))).withColumn("distance", F.sum("__s").over(w)).drop("__s")


def unroll(df: DataFrame, by: list[str], order: str, lon: str) -> DataFrame:
    """Longitudes without jumps at the date line."""
    w = Window.partitionBy(*by).orderBy(order)
    d = F.col(lon) - F.lag(lon).over(w)
    df = df.withColumn("__j", F.when(d > 180, -1).when(d < -180, 1).otherwise(0))
    return df.withColumn("unrolled", F.col(lon) + 360.0 * F.sum("__j").over(w)).drop("__j")


def shuffled(df: DataFrame, key: str, seed: int) -> Column:
    """Place of a row in a fixed shuffle: an integer hash of its key."""
    return (F.col(key).cast("long") * 1103515245 + F.lit(seed) * 12345) % 2147483647


def fraction(df: DataFrame, by: list[str], key: str, start: float, end: float, seed: int = 1) -> DataFrame:
    """Rows from floor(start * n) up to floor(end * n) of each group's fixed shuffle. Counts by bucket of the shuffle's place tell the two buckets
    in which the bounds lie; only rows of these are ranked, all others are in or out by their bucket. A group's rows are never sorted."""
    rows = df.withColumn("__p", shuffled(df, key, seed)).withColumn("__b", F.expr("__p div 65536"))
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    upto = F.sum("__n").over(w.orderBy("__b"))
    counts = counts.select(*by, "__b", (upto - F.col("__n")).alias("__before"), "__n", F.sum("__n").over(w).alias("__all"))
    low, high = F.floor(F.lit(start) * F.col("__all")), F.floor(F.lit(end) * F.col("__all"))
    inside = (F.col("__before") >= low) & (F.col("__before") + F.col("__n") <= high)
    cut = (F.col("__before") < high) & (F.col("__before") + F.col("__n") > low) & ~inside
    marked = rows.join(counts.select(*by, "__b", "__before", low.alias("__lo"), high.alias("__hi"), inside.alias("__in"), cut.alias("__cut")).where("__in or __cut"), [*by, "__b"])
    rank = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__p", key)) - 1 + F.col("__before")
    edge = marked.where("__cut").withColumn("__r", rank).where("__r >= __lo and __r < __hi")
    return marked.where("__in").select(*df.columns).unionByName(edge.select(*df.columns))


def split_by_day(time: Column) -> Column:
    day = F.dayofmonth(time)
    return F.when(day <= 3, "test").when(day <= 5, "validation").otherwise("training")


def tiles(n: int, tile: int, overlap: int) -> list[int]:
    """Starts of overlapping tiles; the last one ends with the data."""
    starts = list(range(0, max(1, n - tile + 1), tile - overlap))
    return starts if n <= tile or starts[-1] + tile >= n else [*starts, n - tile]


def assemble(df: DataFrame, by: list[str], order: str, value: str, n: int, tile: int, overlap: int) -> DataFrame:
    """Cut into tiles and put together again with weights that ramp linearly over the overlap."""
    spans = df.sparkSession.createDataFrame([(s,) for s in tiles(n, tile, overlap)], "start int")
    cut = df.join(F.broadcast(spans), (F.col(order) >= F.col("start")) & (F.col(order) < F.col("start") + tile))  # the spans are a few rows
    place = F.col(order) - F.col("start")
    weight = F.least(F.lit(1.0), (place + 1) / (overlap + 1), (tile - place) / (overlap + 1))
    return cut.groupBy(*by, order).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias(value))


def crossing(curve: DataFrame, by: list[str], x: str, y: str, level: float) -> DataFrame:
    """(by, at): where a curve first rises to a level, linear between its points. A curve has few points."""
    w = Window.partitionBy(*by).orderBy(x)
    ahead = curve.select(*by, x, y, F.lead(x).over(w).alias("__x"), F.lead(y).over(w).alias("__y")).where((F.col(y) < level) & (F.col("__y") >= level))
    return ahead.groupBy(*by).agg(F.min(F.col(x) + (F.col("__x") - F.col(x)) * (level - F.col(y)) / (F.col("__y") - F.col(y))).alias("at"))
