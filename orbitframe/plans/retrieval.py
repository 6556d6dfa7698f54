"""Queries of whole retrievals: from pixels of granules to the contents of result files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orbitframe.operators import retrieval, score
from orbitframe.plans.formats import F4, _pixels as preprocessor_pixels, f4
from orbitframe.plans.profiles import OCEAN
from orbitframe.plans.registry import query
from orbitframe.plans.verification import rounded
from orbitframe.sources import store, swathfiles
from orbitframe.sources.fixtures import OBS_SQL, obs


def network(width: int = 128, depth: int = 6, quantiles: int = 64, seed: int = 0) -> list[dict[str, np.ndarray]]:
    """A residual network with fixed random weights; what it says means nothing, what it costs does."""
    r = np.random.default_rng(seed)
    sizes = [15 + 3 + retrieval.SURFACES + retrieval.AIRMASSES, *[width] * depth, quantiles]
    return [{"w": r.normal(size=(a, b)) / np.sqrt(a)} for a, b in zip(sizes, sizes[1:], strict=False)]


def _pixels(spark, sf):
    tb = F.array(*(F.col("t2m") - 3.0 * k for k in range(15)))
    return obs(spark, sf).select("sample_id", "granule", "scan", "pixel", "latitude", "longitude", tb.alias("tb"), F.lit(52.8).alias("angle"), "t2m", "tcwv", "surface_type", "airmass_type")


@query("m08_retrieval")
def m08(spark, sf):
    out = retrieval.retrieve(_pixels(spark, sf), network(), dtype="f4")
    return rounded(out.drop("tb", "angle"))


@query("m06_linear_retrieval", f"WITH {OBS_SQL}, q AS (SELECT sample_id, list_sort(list_transform(range(4), lambda k: (t2m - 3.0 * k) / 300)) AS q FROM obs) SELECT sample_id, round(q[1] / 5 + q[4] / 5 + (q[1] + 2 * q[2] + 2 * q[3] + q[4]) / 10, 6) AS surface_precip, round(q[1] * (1 - 2 / 3::DOUBLE) + q[2] * (2 / 3::DOUBLE), 6) AS precip_1st_tercile, 1 AS precip_flag FROM q")
def m06l(spark, sf):
    """A network of one layer, whose quantiles are four channels, so that SQL has the same answer."""
    w = np.zeros((40, 4))
    w[[0, 1, 2, 3], [0, 1, 2, 3]] = 1
    out = retrieval.retrieve(_pixels(spark, sf), [{"w": w}])
    return rounded(out.select("sample_id", "surface_precip", "precip_1st_tercile", "precip_flag"))


EDGES = np.arange(17) / 16.0


@query("m03_density_retrieval", f"""WITH {OBS_SQL}, l AS (SELECT sample_id, list_transform(range(16), lambda k: exp(CASE k WHEN 0 THEN t2m / 300 WHEN 3 THEN (t2m - 9) / 300 WHEN 12 THEN 2 * t2m / 300 ELSE 0 END)) AS e,
    ((sample_id % 2147483647) * 1103515245 + 12345) % 2147483647 AS h FROM obs), p AS (SELECT sample_id, list_transform(e, lambda v: v / list_sum(e)) AS p, (h + 0.5::DOUBLE) / 2147483647.0::DOUBLE AS u FROM l),
    c AS (SELECT *, list_transform(range(17), lambda k: coalesce(list_sum(p[1:k]), 0)) AS c FROM p), v AS (SELECT *, len(list_filter(c[1:16], lambda v: v <= u)) AS k, len(list_filter(c[1:16], lambda v: v <= 1 / 3::DOUBLE)) AS k1 FROM c)
    SELECT sample_id, round(list_sum(list_transform(range(1, 17), lambda k: p[k] * (k - 0.5) / 16)), 6) AS surface_precip, round((k1 - 1 + (1 / 3::DOUBLE - c[k1]) / p[k1]) / 16, 6) AS precip_1st_tercile,
    round(1 - p[1] * 0.0016, 6) AS pop, round((k - 1 + (u - c[k]) / p[k]) / 16, 5) AS precip_sample FROM v""")
def m03(spark, sf):
    """One layer whose answers are logits of 16 bins: mean, tercile, probability of precipitation and a draw."""
    w = np.zeros((40, 16))
    w[0, 0] = w[3, 3] = 1
    w[0, 12] = 2
    out = retrieval.retrieve(_pixels(spark, sf), [{"w": w}], edges=EDGES, key="sample_id")
    return rounded(out.select("sample_id", "surface_precip", "precip_1st_tercile", "pop")).join(out.select("sample_id", F.round("precip_sample", 5).alias("precip_sample")), "sample_id")


@query("m07_gradient", f"""WITH {OBS_SQL}, x AS (SELECT sample_id, t2m / 300 AS a, (t2m - 3) / 300 AS b FROM obs), h AS (SELECT *, [a + b, 2 * a, b - a] AS h FROM x),
    n AS (SELECT *, list_avg(h) AS m, sqrt(list_avg(list_transform(h, lambda v: (v - list_avg(h)) ** 2)) + 0.00001) AS s FROM h), z AS (SELECT *, list_transform(h, lambda v: (v - m) / s) AS z FROM n),
    d AS (SELECT *, list_transform([1, 2, 3], lambda i: CASE WHEN z[i] > 0 THEN [1.0, 0.5, 0.25][i]::DOUBLE ELSE 0 END) AS d FROM z),
    g AS (SELECT *, list_transform([1, 2, 3], lambda i: (d[i] - list_avg(d) - z[i] * (d[1] * z[1] + d[2] * z[2] + d[3] * z[3]) / 3) / s) AS g FROM d)
    SELECT sample_id, round(g[1] + 2 * g[2] - g[3], 5) AS by_first, round(g[1] + g[3], 5) AS by_second FROM g""")
def m07(spark, sf):
    """Derivatives of a network of two layers, back through its norm."""
    w, last = np.array([[1.0, 2, -1], [1, 0, 1]]), np.array([[1.0], [0.5], [0.25]])
    x = obs(spark, sf).select("sample_id", F.array(F.col("t2m") / 300, (F.col("t2m") - 3) / 300).alias("x"))
    out = score.score_gradient(x, "x", [{"w": w}, {"w": last}])
    return out.select("sample_id", (F.round(F.get("gradient", F.lit(0)), 5) + 0.0).alias("by_first"), (F.round(F.get("gradient", F.lit(1)), 5) + 0.0).alias("by_second"))


@query("m08_retrieval_files", f"""WITH {OBS_SQL}, q AS (SELECT *, list_sort(list_transform(range(4), lambda k: (t2m - 3.0 * k) / 300)) AS q FROM obs) SELECT granule::INT AS granule, scan::INT AS scan, pixel::INT AS pixel,
    {F4.format('q[1] / 5 + q[4] / 5 + (q[1] + 2 * q[2] + 2 * q[3] + q[4]) / 10')} AS surface_precip, {F4.format('q[1] * (1 - 2 / 3::DOUBLE) + q[2] * 2 / 3::DOUBLE')} AS first_tercile, 80 AS pop,
    CASE WHEN tcwv < 0 THEN 4 WHEN t2m > 325 OR t2m - 42 < 40 THEN 2 ELSE 0 END AS pixel_status, least(greatest(round_even(tcwv::FLOAT, 0), 0), 78)::INT AS tcwv, least(greatest(round_even(t2m::FLOAT, 0), 220), 320)::INT AS t2m,
    round((1 - w / 13) * (q[1] / 5 + q[4] / 5 + (q[1] + 2 * q[2] + 2 * q[3] + q[4]) / 10) + 0.0000037, 4) AS frozen FROM (SELECT *, greatest(least(t2m::FLOAT::DOUBLE - 273.15::DOUBLE + 6.5, 13), 0) AS w FROM q)""")
def m08f(spark, sf):
    """From preprocessor files to result files: read, scored by a network whose quantiles are four channels, written with status and clipped ancillary
    data, and read again."""
    source, target = store.workspace(spark, "pp"), store.workspace(spark, "results")
    tb = F.array(*((F.col("two_meter_temperature").cast("double") - 3.0 * k).cast("float") for k in range(15)))
    swathfiles.write_granules(preprocessor_pixels(spark, sf).withColumns({"brightness_temperatures": tb, "wet_bulb_temperature": F.col("two_meter_temperature")}), "preprocessor", source)
    w = np.zeros((40, 4))
    w[[0, 1, 2, 3], [0, 1, 2, 3]] = 1
    retrieval.run_files(spark, source, target, [{"w": w}], (-6.5, 1.0, OCEAN, OCEAN))
    back = swathfiles.read(spark, "retrieval", target, ["granule", "scan", "pixel", "surface_precip", "precip_1st_tercile", "pop", "pixel_status", "total_column_water_vapor", "two_meter_temperature", "frozen_precip"])
    whole = {"pop": "pop", "pixel_status": "pixel_status", "tcwv": "total_column_water_vapor", "t2m": "two_meter_temperature"}
    return back.select("granule", "scan", "pixel", f4("surface_precip").alias("surface_precip"), f4("precip_1st_tercile").alias("first_tercile"), F.round(F.col("frozen_precip").cast("double") + 0.0000037, 4).alias("frozen"), *(F.col(c).cast("int").alias(k) for k, c in whole.items()))
