"""Retrieval of granules: features of each pixel, a network's distribution, what is reported of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions import physics, tables
from orbitframe.operators import posterior, score
from orbitframe.sources import swathfiles

SURFACES, AIRMASSES = 18, 4


def features(tb: Column, angle: Column, t2m: Column, tcwv: Column, surface: Column, airmass: Column) -> Column:
    """Channels, incidence angle, temperature, water vapour, one-hot surface and airmass. Channels outside 0 to 500 K count as -1.5, as in training;
    a negative airmass counts as 0."""
    channels = F.transform(tb, lambda t: F.when((t >= 0) & (t <= 500), t / 300).otherwise(-1.5))
    one = lambda c, n, first: F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: (i == c).cast("double"))
    return F.concat(channels, F.array(angle / 90, t2m / 300, tcwv / 80), one(surface, SURFACES, 1), one(F.greatest(airmass, F.lit(0)), AIRMASSES, 0))


def retrieve(pixels: DataFrame, layers: score.Layers, tb: str = "tb", edges: np.ndarray | None = None, key: str | None = None, hyper: bool = False, dtype: str = "f8") -> DataFrame:
    """Pixels (granule, scan, pixel, tb, angle, t2m, tcwv, surface_type, airmass_type, ...) with surface_precip, terciles, probability of precipitation,
    precip_flag and, for an integer `key`, a draw. The network gives quantiles, or logits of bins with the given edges. No shuffle: pixels are scored
    where they are read, and five numbers a pixel come back. Pixels whose channels are all negative have no result."""
    x = features(F.col(tb), F.col("angle"), F.col("t2m"), F.col("tcwv"), F.col("surface_type"), F.col("airmass_type"))
    ready = pixels.withColumns({"__x": x, "__u": posterior.level_of(F.col(key)) if key else F.lit(0.5)})
    model = [{k: np.asarray(v, dtype) for k, v in layer.items()} for layer in layers]
    names = {k: score.DOUBLE for k in ("mean", "tercile_1", "tercile_2", "pop", "sample")}

    def answer(values: np.ndarray, own: score.Layers, u: np.ndarray) -> dict[str, np.ndarray]:
        y = score.forward(values.astype(dtype), own, hyper)
        found = posterior.of_quantiles(y, u) if edges is None else posterior.of_density(np.asarray(y, float), edges, u)
        return {f"__{k}": v for k, v in found.items()}

    scored = score.answers(ready, "__x", {f"__{k}": t for k, t in names.items()}, answer, model, ["__u"], ["__x", "__u"])
    valid = F.exists(tb, lambda t: t >= 0)
    out = {"surface_precip": F.greatest(F.col("__mean"), F.lit(0.0)), "precip_1st_tercile": F.col("__tercile_1"), "precip_2nd_tercile": F.col("__tercile_2"), "pop": F.col("__pop")}
    if key:
        out["precip_sample"] = F.col("__sample")
    scored = scored.withColumns({k: F.when(valid, c) for k, c in out.items()}).drop(*(f"__{k}" for k in names))
    return scored.withColumn("precip_flag", (F.col("pop") > 0.5).cast("int"))


#: Columns of a preprocessor file that a retrieval or its result file needs; others are not decoded.
NEEDED = ["granule", "scan", "pixel", "scan_date", "scan_latitude", "scan_longitude", "scan_altitude", "latitude", "longitude", "brightness_temperatures", "earth_incidence_angle",
          "wet_bulb_temperature", "total_column_water_vapor", "two_meter_temperature", "quality_flag", "sunglint_angle", "surface_type", "airmass_type"]


def result_columns(scored: DataFrame, liquid: tuple[float, float, list[float], list[float]] | None = None) -> DataFrame:
    """A result file's fields of scored preprocessor pixels: status, clipped ancillary data, rates and what follows from them. Without a result rates
    are missing and pop is 0. `liquid` is the share of liquid precipitation by wet-bulb temperature, in per cent: the first temperature (degrees
    Celsius), the step, and the tables over ocean and over land; without it frozen precipitation is missing."""
    surface, rate = F.col("surface_type"), F.col("surface_precip")
    wet = F.col("wet_bulb_temperature").cast("double") - 273.15
    frozen = F.lit(None).cast("double") if liquid is None else tables.frozen_precip(wet, surface, rate, *liquid)
    whole = lambda c, low, high: F.least(F.greatest(F.rint(c), F.lit(float(low))), F.lit(float(high)))
    status = physics.pixel_status(F.col("latitude"), F.col("brightness_temperatures"), [F.col("two_meter_temperature"), F.col("total_column_water_vapor"), surface, F.col("airmass_type")])
    return scored.select(
        "granule", "scan", "pixel", "scan_latitude", "scan_longitude", "scan_altitude", F.concat("scan_date", F.array(F.lit(0).cast("smallint"))).alias("scan_date"), "latitude", "longitude",
        status.cast("tinyint").alias("pixel_status"), F.col("quality_flag").cast("tinyint").alias("l1c_quality_flag"), "surface_type", whole("total_column_water_vapor", 0, 78).cast("tinyint").alias("total_column_water_vapor"),
        whole("two_meter_temperature", 220, 320).cast("smallint").alias("two_meter_temperature"), "airmass_type", "sunglint_angle", F.floor(F.coalesce("pop", F.lit(0.0)) * 100).cast("tinyint").alias("pop"),
        F.coalesce("precip_flag", F.lit(0)).cast("tinyint").alias("precip_flag"), rate.cast("float").alias("surface_precip"), rate.cast("float").alias("most_likely_precip"),
        F.col("precip_1st_tercile").cast("float").alias("precip_1st_tercile"), F.col("precip_2nd_tercile").cast("float").alias("precip_2nd_tercile"), frozen.cast("float").alias("frozen_precip"),
    )


def run_files(spark: SparkSession, source: str, target: str, layers: score.Layers, liquid: tuple | None = None, **options) -> None:
    """Preprocessor files at source to one result file a granule at target: read in ranges of scans, scored where they are read, and dealt by
    granule once to be written."""
    pixels = swathfiles.read(spark, "preprocessor", source, NEEDED)
    angle = F.get("earth_incidence_angle", F.lit(0))
    ready = pixels.withColumns({"tb": F.transform("brightness_temperatures", lambda t: t.cast("double")), "angle": angle.cast("double"), "t2m": F.col("two_meter_temperature").cast("double"), "tcwv": F.col("total_column_water_vapor").cast("double")})
    scored = retrieve(ready, layers, **options).drop("tb", "angle", "t2m", "tcwv")
    swathfiles.write_granules(result_columns(scored, liquid), "retrieval", target)
