"""Queries of the scalar and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions import geo, physics
from orbitframe.functions.clean import limits
from orbitframe.plans.registry import query
from orbitframe.plans.verification import rounded
from orbitframe.sources.fixtures import OBS_SQL, TB_SQL, obs, tb

HAV = "2 * 6371 * asin(least(1, sqrt(sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) ** 2)))"
XYZ = "(n) * cos(radians(latitude)) * cos(radians(longitude)) AS x, n * cos(radians(latitude)) * sin(radians(longitude)) AS y, n * (1 - e2) * sin(radians(latitude)) AS z"


@query("f01_great_circle", f"WITH {OBS_SQL} SELECT sample_id, round({HAV.format(a='latitude', b='(latitude / 2)', c='longitude', d='(longitude / 3)')}, 6) AS km FROM obs")
def f01(spark, sf):
    return rounded(obs(spark, sf).select("sample_id", geo.great_circle(F.col("latitude"), F.col("longitude"), F.col("latitude") / 2, F.col("longitude") / 3).alias("km")))


@query("f02_ecef", f"WITH {OBS_SQL}, c AS (SELECT *, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM obs), m AS (SELECT *, 6378137::DOUBLE / sqrt(1 - e2 * sin(radians(latitude)) ** 2) AS n FROM c), p AS (SELECT sample_id, {XYZ} FROM m) SELECT sample_id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM p")
def f02(spark, sf):
    x, y, z = geo.ecef(F.col("latitude"), F.col("longitude"))
    return obs(spark, sf).select("sample_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query("f03_ecef_round_trip", f"WITH {OBS_SQL} SELECT sample_id, round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM obs")
def f03(spark, sf):
    df = obs(spark, sf)
    x, y, z = geo.ecef(F.col("latitude"), F.col("longitude"))
    df = df.select("sample_id", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon = geo.latlon(F.col("x"), F.col("y"), F.col("z"))
    return df.select("sample_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("f04_local_minutes", f"WITH {OBS_SQL}, l AS (SELECT sample_id, scan_time + to_seconds(trunc(longitude * 240)::INT) AS t FROM obs) SELECT sample_id, (hour(t) * 60 + minute(t))::INT AS minutes FROM l")
def f04(spark, sf):
    t = F.expr("timestampadd(SECOND, cast(longitude * 240 as int), scan_time)")
    return obs(spark, sf).select("sample_id", (F.hour(t) * 60 + F.minute(t)).alias("minutes"))


@query("f06_timestamp_parts", f"WITH {OBS_SQL} SELECT sample_id, make_timestamp(2019, (1 + sample_id % 12)::BIGINT, (1 + sample_id % 28)::BIGINT, (sample_id % 24)::BIGINT, (sample_id % 60)::BIGINT, (sample_id % 59)::DOUBLE) AS t FROM obs")
def f06(spark, sf):
    return obs(spark, sf).select("sample_id", F.expr("make_timestamp_ntz(2019, cast(1 + sample_id % 12 as int), cast(1 + sample_id % 28 as int), cast(sample_id % 24 as int), cast(sample_id % 60 as int), cast(sample_id % 59 as decimal(16,6)))").alias("t"))


@query("f07_surface_names", f"WITH {OBS_SQL} SELECT list_extract({list(physics.SURFACES)!r}, surface_type) AS surface, count(*) AS n FROM obs GROUP BY 1")
def f07(spark, sf):
    return obs(spark, sf).groupBy(physics.surface_name(F.col("surface_type")).alias("surface")).agg(F.count("*").alias("n"))


@query("f08_file_names", "SELECT o_orderkey, regexp_extract(name, '\\.(\\d{8})\\.', 1) AS day, regexp_extract(name, '_(\\d+)\\.nc$', 1)::BIGINT AS granule FROM (SELECT o_orderkey, 'mrms.' || strftime(o_orderdate, '%Y%m%d') || '.sim_' || lpad(o_orderkey::VARCHAR, 6, '0') || '.nc' AS name FROM orders)")
def f08(spark, sf):
    name = F.concat(F.lit("mrms."), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".sim_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(".nc"))
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", name.alias("name"))
    return df.select("o_orderkey", F.regexp_extract("name", r"\.(\d{8})\.", 1).alias("day"), F.regexp_extract("name", r"_(\d+)\.nc$", 1).cast("long").alias("granule"))


@query("f11_snow_correction", f"WITH {OBS_SQL} SELECT sample_id, round(surface_precip - 0.3 * surface_precip + 0.3 * surface_precip * (1 + rqi), 6) AS v FROM obs")
def f11(spark, sf):
    return rounded(obs(spark, sf).select("sample_id", physics.snow_correction(F.col("surface_precip"), 0.3 * F.col("surface_precip"), 1 + F.col("rqi")).alias("v")), 0.0)


@query("f15_small_values", f"WITH {OBS_SQL} SELECT sample_id, CASE WHEN surface_precip < 0.5 THEN 0 ELSE surface_precip END::DOUBLE AS v FROM obs")
def f15(spark, sf):
    return obs(spark, sf).select("sample_id", F.when(F.col("surface_precip") < 0.5, 0.0).otherwise(F.col("surface_precip")).alias("v"))


@query("f17_t2m_index", f"WITH {OBS_SQL} SELECT sample_id, (greatest(least(round_even((t2m - 268) / 3, 0), 12), 1) - 1)::INT AS i FROM obs")
def f17(spark, sf):
    return obs(spark, sf).select("sample_id", physics.t2m_index(F.col("t2m")).alias("i"))


@query("f18_bias_scale", f"WITH {TB_SQL} SELECT vec_id, round(cos(radians(52.8)) / cos(radians(tb[1] / 10)), 6) AS scale FROM tb")
def f18(spark, sf):
    return rounded(tb(spark, sf).select("vec_id", (F.cos(F.radians(F.lit(52.8))) / F.cos(F.radians(F.get("tb", F.lit(0)) / 10))).alias("scale")))


@query("f20_pixel_status", f"WITH {TB_SQL} SELECT vec_id, CASE WHEN profile[1] < 0 OR profile[2] < 0 THEN 4 WHEN list_min(tb) < 200 OR list_max(tb) > 325 THEN 2 ELSE 0 END AS status FROM (SELECT vec_id, profile, list_transform(tb, lambda t: t) AS tb FROM tb)".replace("list_min(tb) < 200", "list_min(tb) < 40"))
def f20(spark, sf):
    return tb(spark, sf).select("vec_id", physics.pixel_status(F.lit(0.0), F.col("tb"), [F.get("profile", F.lit(0)), F.get("profile", F.lit(1))]).alias("status"))


@query("f21_clip_round", f"WITH {OBS_SQL} SELECT sample_id, least(greatest(round_even(tcwv, 0), 0), 78)::INT AS tcwv, least(greatest(round_even(t2m, 0), 220), 320)::INT AS t2m FROM obs")
def f21(spark, sf):
    return obs(spark, sf).select("sample_id", physics.clip_round(F.col("tcwv"), 0, 78).alias("tcwv"), physics.clip_round(F.col("t2m"), 220, 320).alias("t2m"))


@query("f27_valid_temperatures", f"WITH {TB_SQL} SELECT vec_id, len(list_filter(tb, lambda t: t >= 210 AND t <= 230)) AS n FROM tb")
def f27(spark, sf):
    t = F.transform("tb", lambda x: limits(x, 210, 230))
    return tb(spark, sf).select("vec_id", F.size(F.array_compact(t)).cast("long").alias("n"))


@query("f28_linear_reflectivity", f"WITH {OBS_SQL} SELECT surface_type, round(10 * log10(avg(pow(10, surface_precip / 10))), 6) AS dbz FROM obs GROUP BY surface_type")
def f28(spark, sf):
    return rounded(obs(spark, sf).groupBy("surface_type").agg(physics.to_dbz(F.avg(physics.to_linear(F.col("surface_precip")))).alias("dbz")))


@query("p01_limits", f"WITH {OBS_SQL} SELECT sample_id, CASE WHEN t2m >= 250 AND t2m <= 300 THEN t2m END AS t2m, CASE WHEN tcwv >= 10 THEN tcwv END AS tcwv FROM obs")
def p01(spark, sf):
    return obs(spark, sf).select("sample_id", limits(F.col("t2m"), 250, 300).alias("t2m"), limits(F.col("tcwv"), 10).alias("tcwv"))


@query("p04_training_pixels", f"WITH {TB_SQL} SELECT vec_id FROM tb WHERE list_min(tb) > 0 AND list_max(tb) < 240")
def p04(spark, sf):
    return tb(spark, sf).where(F.forall("tb", lambda t: (t > 0) & (t < 240))).select("vec_id")


@query("p12_null_by_surface", f"WITH {OBS_SQL} SELECT sample_id, CASE WHEN surface_type NOT BETWEEN 8 AND 11 THEN surface_precip END AS sim, CASE WHEN surface_type IN (2, 16) THEN surface_precip END AS ice FROM obs")
def p12(spark, sf):
    st = F.col("surface_type")
    return obs(spark, sf).select("sample_id", F.when(~st.between(8, 11), F.col("surface_precip")).alias("sim"), F.when(st.isin(2, 16), F.col("surface_precip")).alias("ice"))


@query("r01_one_hot", f"WITH {OBS_SQL} SELECT surface_type, list_transform(range(1, 19), lambda i: (surface_type = i)::INT) AS hot, count(*) AS n FROM obs GROUP BY surface_type")
def r01(spark, sf):
    return obs(spark, sf).groupBy("surface_type").agg(F.count("*").alias("n")).withColumn("hot", physics.one_hot(F.col("surface_type"), 1, 18))


@query("r02_one_hot_decode", f"WITH {OBS_SQL} SELECT sample_id, surface_type::BIGINT AS code FROM obs")
def r02(spark, sf):
    df = obs(spark, sf).select("sample_id", physics.one_hot(F.col("surface_type"), 1, 18).alias("hot"))
    return df.select("sample_id", F.array_position("hot", 1).alias("code"))


@query("r04_expand_channels", f"WITH {TB_SQL} SELECT vec_id, list_transform([tb[1], tb[2], tb[3], tb[4], tb[5], NULL, tb[6], tb[7], tb[8], tb[9], tb[10], tb[11], NULL, tb[12], tb[13]], lambda x: coalesce(round(x, 6), -9999.0::DOUBLE)) AS tb FROM tb")
def r04(spark, sf):
    return tb(spark, sf).select("vec_id", F.transform(physics.expand_channels(F.col("tb")), lambda x: F.coalesce(F.round(x, 6), F.lit(-9999.0))).alias("tb"))


HEIGHTS = [0.5 * (i + 1) for i in range(20)] + [float(k) for k in range(11, 19)]


@query("r06_path_integral", f"WITH {TB_SQL}, h AS (SELECT {HEIGHTS!r}::DOUBLE[] AS h) SELECT vec_id, round(list_sum(list_transform(range(2, 29), lambda i: (profile[i] + profile[i - 1]) * (h[i] - h[i - 1]) / 2)), 6) AS path FROM tb, h")
def r06(spark, sf):
    return rounded(tb(spark, sf).select("vec_id", physics.path_integral(F.col("profile"), HEIGHTS).alias("path")))


@query("r10_profile_difference", f"WITH {TB_SQL} SELECT vec_id, list_transform(range(1, 29), lambda i: round(profile[29 - i] - profile[i], 6) + 0.0) AS d FROM tb")
def r10(spark, sf):
    return tb(spark, sf).select("vec_id", F.zip_with(F.reverse("profile"), "profile", lambda a, b: F.round(a - b, 6) + 0.0).alias("d"))


@query("r12_any_over_channels", f"WITH {TB_SQL} SELECT vec_id, list_max(tb) > 240 AS any_high, list_min(profile) > -0.2 AS all_above FROM tb")
def r12(spark, sf):
    return tb(spark, sf).select("vec_id", F.exists("tb", lambda t: t > 240).alias("any_high"), F.forall("profile", lambda x: x > -0.2).alias("all_above"))


LEVELS = [(i + 1) / 16 for i in range(15)]
SORTED = "sorted AS (SELECT vec_id, list_sort(tb) AS q FROM tb)"


@query("m06_quantile_mean", f"WITH {TB_SQL}, {SORTED} SELECT vec_id, round(q[1] / 16 + q[15] / 16 + list_sum(list_transform(range(2, 16), lambda i: (q[i] + q[i - 1]) / 32)), 6) AS mean FROM sorted")
def m06(spark, sf):
    df = tb(spark, sf).select("vec_id", F.array_sort("tb").alias("q"))
    return rounded(df.select("vec_id", physics.quantile_mean(F.col("q"), LEVELS).alias("mean")))


@query("r11_normalise", f"WITH {TB_SQL}, s AS (SELECT min(tb[1]) AS lo, max(tb[1]) AS hi FROM tb) SELECT vec_id, round(2 * (tb[1] - lo) / (hi - lo) - 1, 6) AS x FROM tb, s")
def r11(spark, sf):
    df = tb(spark, sf).select("vec_id", F.get("tb", F.lit(0)).alias("t"))
    lo, hi = df.agg(F.min("t"), F.max("t")).first()
    return rounded(df.select("vec_id", (2 * (F.col("t") - lo) / (hi - lo) - 1).alias("x")))


@query("f10_enhancement", f"WITH {OBS_SQL} SELECT sample_id, round(surface_precip * CASE " + " ".join(f"WHEN surface_type = {s} AND airmass_type = {a} THEN {f}::DOUBLE" for (s, a), f in physics.ENHANCEMENT["ERA5"].items()) + " ELSE 1 END + 1e-9, 6) AS surface_precip FROM obs")
def f10(spark, sf):
    return rounded(obs(spark, sf).select("sample_id", (F.col("surface_precip") * physics.enhancement(F.col("surface_type"), F.col("airmass_type"))).alias("surface_precip")), 1e-9)


@query("f22_conical_inverse", f"WITH {OBS_SQL} SELECT sample_id, round(pixel::DOUBLE, 6) AS pixel FROM obs")
def f22(spark, sf):
    x = physics.conical_x(F.col("pixel"), 25, 130.0, 900.0)
    return obs(spark, sf).select("sample_id", F.round(physics.conical_pixel(x, 25, 130.0, 900.0), 6).alias("pixel"))


@query("m06_exceedance", f"WITH {TB_SQL}, {SORTED}, k AS (SELECT vec_id, q, len(list_filter(q, lambda v: v <= 220)) AS k FROM sorted) SELECT vec_id, round(CASE WHEN k = 0 THEN 1 - 1 / 16::DOUBLE WHEN k = 15 THEN 1 / 16::DOUBLE ELSE 1 - (k / 16 + (220 - q[k]) / (q[k + 1] - q[k]) / 16) END, 6) AS p FROM k")
def m06e(spark, sf):
    df = tb(spark, sf).select("vec_id", F.array_sort("tb").alias("q"))
    return rounded(df.select("vec_id", physics.exceedance(F.col("q"), LEVELS, 220.0).alias("p")))
