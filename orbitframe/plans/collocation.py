"""Queries of the collocation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.operators import collocate as co
from orbitframe.plans.registry import query
from orbitframe.plans.scalars import HAV
from orbitframe.plans.verification import rounded
from orbitframe.sources.fixtures import OBS_SQL, SWATH_SQL, obs, other_swath, swath, table

DIST = HAV.format(a="s.lat", b="o.lat2", c="s.lon", d="o.lon2")
AT, AT2 = ("lat", "lon"), ("lat2", "lon2")
PAIRS = f"pairs AS (SELECT s.granule, s.sample_id AS left_id, o.sample_id, o.tcwv, o.surface_precip, {DIST} AS distance FROM swath s JOIN other o ON o.granule = s.granule AND abs(s.lat - o.lat2) < 0.5 AND abs(s.lon - o.lon2) < 3)"


def _left(spark, sf):
    return swath(spark, sf).select("granule", F.col("sample_id").alias("left_id"), *AT)


@query("j05_nearest_gather", f"WITH {SWATH_SQL}, {PAIRS} SELECT left_id, arg_min(sample_id, distance) AS sample_id, round(min(distance), 6) AS distance FROM pairs WHERE distance <= 20 GROUP BY left_id")
def j05(spark, sf):
    return rounded(co.nearest(_left(spark, sf), other_swath(spark, sf), ["granule"], "left_id", "sample_id", "sample_id", AT, AT2, 20.0))


@query("j02_nearest_scatter", f"WITH {SWATH_SQL}, {PAIRS}, n AS (SELECT sample_id, arg_min(left_id, distance) AS left_id, any_value(tcwv) AS tcwv FROM pairs WHERE distance <= 10 GROUP BY sample_id) SELECT left_id, arg_max(tcwv, sample_id) AS tcwv FROM n GROUP BY left_id")
def j02(spark, sf):
    one = co.nearest(other_swath(spark, sf), _left(spark, sf), ["granule"], "sample_id", "left_id", "left_id", AT2, AT, 10.0)
    hit = one.join(obs(spark, sf).select("sample_id", "tcwv"), "sample_id")
    return hit.groupBy("left_id").agg(F.max_by("tcwv", "sample_id").alias("tcwv"))


@query("j08_gaussian_resample", f"WITH {SWATH_SQL}, {PAIRS} SELECT left_id, round(sum(exp(ln(0.5) * (2 * distance / 10) ** 2) * surface_precip) / sum(exp(ln(0.5) * (2 * distance / 10) ** 2)), 6) AS surface_precip, count(*) AS n FROM pairs WHERE distance <= 20 AND surface_precip IS NOT NULL GROUP BY left_id")
def j08(spark, sf):
    return rounded(co.gaussian_resample(_left(spark, sf), other_swath(spark, sf), ["granule"], "left_id", "surface_precip", AT, AT2, 20.0, 10.0))


@query("j01_granule_match", "SELECT r.o_orderkey AS granule, count(*) AS n FROM orders r JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a USING (o_orderkey) GROUP BY 1")
def j01(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("granule"))
    return o.join(o.where("granule % 3 <> 0"), "granule").groupBy("granule").agg(F.count("*").alias("n"))


@query("j01_missing_granules", "SELECT o_orderkey AS granule FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def j01m(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("granule"))
    return o.join(o.where("granule % 3 <> 0"), "granule", "left_anti")


@query("j10_extract", f"WITH {OBS_SQL}, a AS (SELECT * FROM obs WHERE sample_id % 3 <> 0), m AS (SELECT sample_id, surface_precip AS avg_precip FROM obs WHERE sample_id % 5 = 0) SELECT o.sample_id, o.surface_precip, coalesce(m.avg_precip, o.surface_precip) AS surface_precip_avg, a.surface_type FROM obs o JOIN a USING (sample_id) LEFT JOIN m USING (sample_id) WHERE o.surface_precip >= 0 AND o.surface_precip_ref >= 0 AND o.rqi >= 0.3")
def j10(spark, sf):
    o = obs(spark, sf)
    a, m = o.where("sample_id % 3 <> 0").select("sample_id", "surface_type"), o.where("sample_id % 5 = 0").select("sample_id", F.col("surface_precip").alias("m"))
    kept = o.where("surface_precip >= 0 and surface_precip_ref >= 0 and rqi >= 0.3").select("sample_id", "surface_precip")
    return kept.join(a, "sample_id").join(m, "sample_id", "left").select("sample_id", "surface_precip", F.coalesce("m", "surface_precip").alias("surface_precip_avg"), "surface_type")


@query("j11_as_of", "SELECT o.o_orderkey AS key, (SELECT strftime(max(d), '%Y-%m-%d') FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 50 = 0) f WHERE f.d <= o.o_orderdate::DATE AND f.d >= o.o_orderdate::DATE - 31) AS value FROM orders o")
def j11(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    files = o.where("o_orderkey % 50 = 0").select("d").distinct()
    return co.as_of(o.select(F.col("o_orderkey").alias("key"), "d"), files, "key", F.col("d"), F.col("d"), F.date_format("d", "yyyy-MM-dd"), 31)


@query("j12_effective_sensor", "SELECT CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'early' ELSE 'late' END AS sensor, count(*) AS n FROM orders GROUP BY 1")
def j12(spark, sf):
    dim = spark.sql("SELECT * FROM VALUES ('early', DATE '1900-01-01', DATE '1998-01-01'), ('late', DATE '1998-01-01', DATE '9999-01-01') AS t(sensor, valid_from, valid_to)")
    o = table(spark, sf, "orders")
    return o.join(F.broadcast(dim), (o.o_orderdate >= dim.valid_from) & (o.o_orderdate < dim.valid_to)).groupBy("sensor").agg(F.count("*").alias("n"))


@query("j13_raster_lookup", f"WITH {OBS_SQL}, r AS (SELECT a.range::INT AS lat_idx, b.range::INT AS lon_idx, (a.range * 31 + b.range * 17) % 5 AS v FROM range(18) a, range(36) b) SELECT sample_id, v FROM obs LEFT JOIN r ON lat_idx = floor((latitude + 90) / 10) AND lon_idx = floor((longitude + 180) / 10) % 36")
def j13(spark, sf):
    raster = spark.range(18 * 36).select(F.expr("cast(id div 36 as int)").alias("lat_idx"), (F.col("id") % 36).cast("int").alias("lon_idx")).withColumn("v", ((F.col("lat_idx") * 31 + F.col("lon_idx") * 17) % 5).cast("long"))
    return co.lookup(obs(spark, sf), raster, "latitude", "longitude", 10.0).select("sample_id", "v")


@query("j14_keyed_concat", f"WITH {OBS_SQL} SELECT a.sample_id, a.surface_precip AS surface_precip_a, b.surface_precip_ref AS surface_precip_b FROM obs a JOIN obs b USING (sample_id)")
def j14(spark, sf):
    o = obs(spark, sf)
    return o.select("sample_id", F.col("surface_precip").alias("surface_precip_a")).join(o.select("sample_id", F.col("surface_precip_ref").alias("surface_precip_b")), "sample_id")
