"""Statistics over streams of granules: the same partial tables, kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.operators.stats import merge, partial


def hourly(stream: DataFrame, time: str, keys: list[str], value: str, lateness: str) -> DataFrame:
    """(hour, keys, n, total); rows later than the watermark are dropped."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, "1 hour"), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("hour"), *keys, "n", "total")


def scenes(stream: DataFrame, time: str, key: str, gap: str, lateness: str) -> DataFrame:
    """Runs of scans without a gap: first and last time and number of rows."""
    out = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("end"), "n")


def accumulate(stream: DataFrame, keys: dict[str, Column], value: Column, path: str, checkpoint: str):
    """Start a query that writes each batch's partial table below `path`, by its number, so that a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        partial(batch, keys, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark, path: str) -> DataFrame:
    """The sum of all batches."""
    return merge(spark.read.parquet(path).drop("batch"))


def frames_near(scans: DataFrame, frames: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Each scan (scan_time, ...) of a stream with the radar frames (frame_time, ...) of another that are at most `seconds` away: an equi-join on slots
    of that length, of which a scan takes three. Both sides carry a watermark, so the state holds no more than the interval and the lateness."""
    slot = lambda c: F.floor(F.unix_seconds(c) / seconds)
    a = scans.withWatermark("scan_time", lateness).withColumn("__slot", F.explode(F.sequence(slot("scan_time") - 1, slot("scan_time") + 1)))
    b = frames.withWatermark("frame_time", lateness).withColumn("__own", slot("frame_time"))
    near = F.expr(f"__slot = __own and frame_time between scan_time - interval {seconds} seconds and scan_time + interval {seconds} seconds")
    return a.join(b, near).drop("__slot", "__own")


def closest_frame(pairs: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, frame): the closest of a scan's frames, the earlier one of two equally close."""
    apart = F.abs(F.unix_micros("scan_time") - F.unix_micros("frame_time"))
    return pairs.groupBy(key).agg(F.min_by(frame, F.struct(apart, F.col("frame_time"))).alias(frame))
