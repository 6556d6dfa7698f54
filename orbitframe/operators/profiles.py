"""Profiles as a scale and the index of a normalised centre, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centres of one key; more would not fit the row that holds them.
MOST_CENTRES = 4096


def normalised(profile):
    """A profile divided by its sum; null where the sum is 0."""
    total = F.aggregate(profile, F.lit(0.0), lambda s, v: s + v)
    return F.transform(profile, lambda v: F.try_divide(v, total))


def compress(df: DataFrame, centres: DataFrame, key: str, profile: str) -> DataFrame:
    """df with (scale, idx, mse): the profile's sum and the nearest of its key's centres by mean squared difference of the normalised profile.

    centres (key, idx, centre) has a few dozen rows a key, held as one array a key, so each profile is compared in place and no pairs arise.
    A profile with sum 0, or a key without centres, has a null index.
    """
    packed = centres.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "centre"))).alias("__centres"))
    packed = packed.withColumn("__centres", F.when(F.size("__centres") <= MOST_CENTRES, F.col("__centres")).otherwise(F.raise_error(F.lit("too many centres of one key"))))
    shape = F.col("__shape")
    scored = F.transform("__centres", lambda c: F.struct(F.aggregate(F.zip_with(shape, c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("sum"), c["idx"].alias("idx")))
    best = F.array_min(F.filter(scored, lambda s: s["sum"].isNotNull()))
    out = df.withColumns({"scale": F.aggregate(F.col(profile), F.lit(0.0), lambda s, v: s + v), "__shape": normalised(F.col(profile))})
    out = out.join(packed, key, "left").withColumn("__best", best)
    return out.select(*df.columns, "scale", F.col("__best.idx").alias("idx"), F.try_divide(F.col("__best.sum"), F.size(profile).cast("double")).alias("mse"))


def decode(df: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """df (key, idx, scale, ...) with the profile that the index and scale stand for; null without an index."""
    return df.join(centres.select(key, "idx", "centre"), [key, "idx"], "left").withColumn("decoded", F.transform("centre", lambda v: v * F.col("scale"))).drop("centre")
