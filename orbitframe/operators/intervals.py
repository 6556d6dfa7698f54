"""Which granule was observed at a time: a join of points with intervals by equal buckets of time.

An interval stands in each bucket of `step` seconds that it touches, so a point meets the intervals of one bucket; a granule of 95 minutes stands
in two buckets of two hours at most. Intervals of any length are right; long ones take more rows."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unwrapped(start: Column, end: Column) -> Column:
    """The end of a granule whose times of day share a date: it is of the next day if it lies before the start."""
    return F.when(end < start, end + F.expr("interval 1 day")).otherwise(end)


def bucket(at: Column, step: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / (step * 1_000_000))


def containing(points: DataFrame, catalogue: DataFrame, by: list[str], at: str, start: str, end: str, step: int = 7200) -> DataFrame:
    """Rows of points with each row of the catalogue (by, start, end, ...) whose closed interval holds them."""
    spans = catalogue.withColumn("__b", F.explode(F.sequence(bucket(F.col(start), step), bucket(F.col(end), step))))
    met = points.withColumn("__b", bucket(F.col(at), step)).join(spans, [*by, "__b"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__b")


def stretches(catalogue: DataFrame, by: list[str], start: str, end: str, file: str, step: int) -> DataFrame:
    """(by, __b, __at, n, file): in each bucket, from which microsecond on how many closed intervals hold the time and the first of them by name. A
    bucket's intervals are swept in their order in time, so there are at most two stretches an interval, however many overlap."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = catalogue.where(F.col(start) <= F.col(end)).select(*by, micros(start).alias("__s"), (micros(end) + 1).alias("__e"), file, F.explode(F.sequence(bucket(F.col(start), step), bucket(F.col(end), step))).alias("__b"))
    kinds = dict(spans.dtypes)

    def sweep(pdf):
        import pandas as pd

        pdf = pdf.sort_values("__s", kind="stable")
        begin, stop, names = pdf["__s"].tolist(), pdf["__e"].tolist(), pdf[file].tolist()
        ends, k, gone, open_, rows = sorted(stop), 0, 0, [], []
        for at in sorted({*begin, *stop}):
            while k < len(begin) and begin[k] <= at:
                heapq.heappush(open_, (names[k], stop[k]))
                k += 1
            while gone < len(ends) and ends[gone] <= at:
                gone += 1
            while open_ and open_[0][1] <= at:
                heapq.heappop(open_)
            rows.append((at, k - gone, open_[0][0] if open_ else None))
        out = pd.DataFrame(rows, columns=["__at", "n", file])
        return out.assign(**{c: pdf[c].iloc[0] for c in (*by, "__b")})[[*by, "__b", "__at", "n", file]]

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "__b bigint, __at bigint, n bigint", f"`{file}` string"])
    return spans.dropna(subset=[*by, file]).groupBy(*by, "__b").applyInPandas(sweep, schema)


def first_at(points: DataFrame, catalogue: DataFrame, by: list[str], key: str, at: str, start: str, end: str, file: str, step: int = 7200) -> DataFrame:
    """(key, n, file): for each point, how many files hold its time and the first of them by name; null if none does. A point takes what was said
    last before it in its bucket, so no point meets an interval; points are not combined by key."""
    said = stretches(catalogue, by, start, end, file, step)
    own = points.select(key, *by, bucket(F.col(at), step).alias("__b"), F.unix_micros(F.col(at).cast("timestamp")).alias("__at"), F.lit(True).alias("__point"))
    both = own.unionByName(said.select(*by, "__b", "__at", F.struct("n", file).alias("__said"), F.lit(False).alias("__point")), allowMissingColumns=True)
    w = Window.partitionBy(*by, "__b").orderBy("__at", "__point").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__said", F.last("__said", True).over(w)).where("__point")
    return found.select(key, F.coalesce("__said.n", F.lit(0).cast("long")).alias("n"), F.col(f"__said.{file}").alias(file))


def by_number(catalogue: DataFrame, granule: str, file: str) -> DataFrame:
    """(granule, file); a granule with more than one file is an error."""
    found = catalogue.groupBy(granule).agg(F.min(file).alias(file), F.max(file).alias("__last"))
    message = F.concat(F.lit("more than one file of granule "), F.col(granule).cast("string"))
    return found.select(granule, F.when(F.col(file) == F.col("__last"), F.col(file)).otherwise(F.raise_error(message).cast("string")).alias(file))
