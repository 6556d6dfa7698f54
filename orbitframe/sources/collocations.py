"""Collocations of a reference with several retrievals, stored by month and read as one long table of samples.

A stored row is a place of a granule: the reference rate and its smoothed form, a rate and a probability of precipitation for each group, and what
filters need (surface_type, rqi, mask, latitude, longitude, scan_time). Folders of year and month, which a range of days prunes, hold files of even
size, sorted by granule."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = ["year", "month"]


def write(places: DataFrame, path: str, mode: str = "error") -> None:
    """Rows (granule, scan_time, ...) as a table at path; a crowded month is split over tasks."""
    dated = places.withColumns({"year": F.year("scan_time"), "month": F.month("scan_time")}).hint("rebalance", *MONTH)
    dated.sortWithinPartitions(*MONTH, "granule").write.partitionBy(*MONTH).mode(mode).parquet(path)


def read(spark: SparkSession, path: str, first: date | None = None, after: date | None = None) -> DataFrame:
    """The stored rows of days in [first, after); months beside them are not read."""
    rows, month = spark.read.parquet(path), F.col("year") * 12 + F.col("month")
    if first is not None:
        rows = rows.where((month >= first.year * 12 + first.month) & (F.col("scan_time") >= F.lit(first).cast("timestamp")))
    if after is not None:
        rows = rows.where((month <= after.year * 12 + after.month) & (F.col("scan_time") < F.lit(after).cast("timestamp")))
    return rows.drop(*MONTH)


def samples(places: DataFrame, groups: list[str], rqi: float | None = None, masks: list[int] | None = None, common: bool = True) -> DataFrame:
    """(grp, surface_precip, pop, the columns that are not of a group): one row for each group with a valid rate where the reference has one. A group
    has the columns surface_precip_<group> and, if it says so, pop_<group>. common: a place counts only if all groups are valid there, so that
    groups are compared on the same places. One pass, no shuffle: places become rows of samples where they are read."""
    keep = F.col("surface_precip_ref") >= 0
    keep = keep if rqi is None else keep & (F.col("rqi") >= rqi)
    keep = keep if masks is None else keep & F.col("mask").isin(masks)
    rate = {g: F.col(f"surface_precip_{g}") for g in groups}
    if common:
        for g in groups:
            keep = keep & (rate[g] >= 0)
    pop = {g: F.col(f"pop_{g}") if f"pop_{g}" in places.columns else F.lit(None) for g in groups}
    own = [c for c in places.columns if c not in {f"{k}_{g}" for k in ("surface_precip", "pop") for g in groups}]
    each = F.array(*(F.struct(F.lit(g).alias("grp"), rate[g].cast("double").alias("surface_precip"), pop[g].cast("double").alias("pop")) for g in groups))
    return places.where(keep).select(*own, F.explode(each).alias("s")).select("s.*", *own).where("surface_precip >= 0")
