"""Queries along scans: windows, sampling, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitframe.functions.clean import signed_round
from orbitframe.operators import sequence as seq
from orbitframe.plans.registry import query
from orbitframe.plans.verification import rounded
from orbitframe.sources.fixtures import OBS_SQL, SWATH_SQL, TB_SQL, obs, swath, table, tb

WET = "surface_precip > 5"


@query("w01_islands", f"WITH {OBS_SQL}, s AS (SELECT DISTINCT granule, pixel, scan FROM obs WHERE {WET}), r AS (SELECT *, scan - row_number() OVER (PARTITION BY granule, pixel ORDER BY scan) AS run FROM s) SELECT granule, pixel, min(scan) AS first, max(scan) AS last, count(*) AS n FROM r GROUP BY granule, pixel, run")
def w01(spark, sf):
    return seq.islands(obs(spark, sf).where(WET), ["granule", "pixel"], "scan")


@query("p07_first_run", f"WITH {OBS_SQL}, s AS (SELECT DISTINCT granule, pixel, scan FROM obs WHERE {WET}), r AS (SELECT *, scan - row_number() OVER (PARTITION BY granule, pixel ORDER BY scan) AS run FROM s), i AS (SELECT granule, pixel, min(scan) AS first, max(scan) - 1 AS last FROM r GROUP BY granule, pixel, run) SELECT granule, pixel, min(first) AS first, arg_min(last, first) AS last FROM i GROUP BY ALL")
def p07(spark, sf):
    return seq.first_run(obs(spark, sf).where(WET), ["granule", "pixel"], "scan")


@query("w02_along_track", f"WITH {SWATH_SQL}, c AS (SELECT granule, scan, lat, lag(lat) OVER (PARTITION BY granule ORDER BY scan) AS p FROM swath WHERE pixel = 12) SELECT granule, scan, round(sum(coalesce(abs(lat - p) * 111.2, 0)) OVER (PARTITION BY granule ORDER BY scan), 6) AS distance FROM c")
def w02(spark, sf):
    df = swath(spark, sf).where("pixel = 12").select("granule", "scan", "lat")
    w = Window.partitionBy("granule").orderBy("scan")
    df = df.withColumn("step", F.abs(F.col("lat") - F.lag("lat").over(w)) * 111.2)
    return rounded(seq.along_distance(df, ["granule"], "scan", F.col("step")).select("granule", "scan", "distance"))


@query("w04_fill_nearest", f"WITH {OBS_SQL} SELECT a.sample_id, round(coalesce(a.surface_precip, (SELECT arg_min(b.surface_precip, abs(b.scan - a.scan) * 2 + (b.scan > a.scan)::INT) FROM obs b WHERE b.granule = a.granule AND b.pixel = a.pixel AND b.surface_precip IS NOT NULL)), 6) AS filled FROM obs a")
def w04(spark, sf):
    return rounded(seq.fill_nearest(obs(spark, sf), ["granule", "pixel"], "scan", "surface_precip").select("sample_id", "filled"))


NEAR = "last_value(CASE WHEN surface_precip IS NOT NULL THEN {x} END IGNORE NULLS) OVER (PARTITION BY granule, pixel ORDER BY scan {d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("w04_fill_linear", f"WITH {OBS_SQL}, n AS (SELECT sample_id, scan, surface_precip, " + ", ".join(f"{NEAR.format(x=x, d=d)} AS {n}" for x, d, n in (("scan", "", "k0"), ("surface_precip", "", "v0"), ("scan", "DESC", "k1"), ("surface_precip", "DESC", "v1"))) + " FROM obs) SELECT sample_id, round(coalesce(surface_precip, CASE WHEN k1 - k0 <= 4 THEN v0 + (v1 - v0) * (scan - k0) / (k1 - k0) END), 6) AS filled FROM n")
def w04l(spark, sf):
    return rounded(seq.fill_linear(obs(spark, sf), ["granule", "pixel"], "scan", "surface_precip", 4).select("sample_id", "filled"))


@query("w06_unroll_longitude", f"WITH {OBS_SQL}, d AS (SELECT sample_id, granule, longitude, longitude - lag(longitude) OVER (PARTITION BY granule ORDER BY sample_id) AS d FROM obs) SELECT sample_id, round(longitude + 360 * sum(CASE WHEN d > 180 THEN -1 WHEN d < -180 THEN 1 ELSE 0 END) OVER (PARTITION BY granule ORDER BY sample_id), 6) AS unrolled FROM d")
def w06(spark, sf):
    return rounded(seq.unroll(obs(spark, sf), ["granule"], "sample_id", "longitude").select("sample_id", "unrolled"))


@query("w07_pair_average", f"WITH {TB_SQL} SELECT vec_id, list_transform(range(1, 15), lambda i: round((profile[2 * i - 1] + profile[2 * i]) / 2, 6)) AS profile FROM tb")
def w07(spark, sf):
    return tb(spark, sf).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: signed_round((F.get("profile", 2 * i) + F.get("profile", 2 * i + 1)) / 2, 6)).alias("profile"))


@query("w08_upsample", f"WITH {OBS_SQL}, n AS (SELECT granule, pixel, scan, tcwv, lead(tcwv) OVER (PARTITION BY granule, pixel ORDER BY scan) AS n FROM obs) SELECT granule, pixel, scan * 3 + k AS fine, round(CASE WHEN k = 0 THEN tcwv ELSE tcwv + (n - tcwv) * k / 3 END, 6) AS tcwv FROM n, range(3) r(k) WHERE k = 0 OR n IS NOT NULL")
def w08(spark, sf):
    return rounded(seq.upsample(obs(spark, sf), ["granule", "pixel"], "scan", "tcwv"))


@query("w09_month_lookback", f"WITH {OBS_SQL}, c AS (SELECT surface_type, month(scan_time)::INT + (sample_id % 12)::INT AS m, airmass_type FROM obs), k AS (SELECT surface_type, (m - 1) % 12 AS month, max(airmass_type) AS v FROM c WHERE airmass_type > 0 GROUP BY ALL), g AS (SELECT DISTINCT surface_type, range::INT AS month FROM k, range(12)) SELECT g.surface_type, g.month, arg_min(k.v, (g.month - k.month + 12) % 12) AS v FROM g JOIN k USING (surface_type) GROUP BY g.surface_type, g.month")
def w09(spark, sf):
    c = obs(spark, sf).select("surface_type", F.pmod(F.month("scan_time") + F.col("sample_id") % 12 - 1, F.lit(12)).cast("int").alias("month"), "airmass_type")
    k = c.where("airmass_type > 0").groupBy("surface_type", "month").agg(F.max("airmass_type").alias("v"))
    back = k.select("surface_type", "v", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"), "month")
    back = back.select("surface_type", F.pmod(F.col("month") + F.col("i"), F.lit(12)).cast("int").alias("month"), "v", "i")
    return back.groupBy("surface_type", "month").agg(F.min_by("v", "i").alias("v"))


@query("w10_decimate", f"WITH {OBS_SQL} SELECT granule, scan, pixel // 2 AS pixel, tcwv FROM obs WHERE pixel % 2 = 0")
def w10(spark, sf):
    return obs(spark, sf).where("pixel % 2 = 0").select("granule", "scan", F.expr("pixel div 2").alias("pixel"), "tcwv")


@query("s02_fraction", f"WITH {OBS_SQL}, r AS (SELECT sample_id, surface_type, row_number() OVER (PARTITION BY surface_type ORDER BY (sample_id * 1103515245 + 12345) % 2147483647, sample_id) - 1 AS r, count(*) OVER (PARTITION BY surface_type) AS n FROM obs) SELECT sample_id, surface_type FROM r WHERE r >= floor(0.2 * n) AND r < floor(0.5 * n)")
def s02(spark, sf):
    return seq.fraction(obs(spark, sf), ["surface_type"], "sample_id", 0.2, 0.5).select("sample_id", "surface_type")


@query("s03_pruned_bins", f"WITH {OBS_SQL} SELECT floor(t2m)::INT AS t2m_bin, floor(tcwv)::INT AS tcwv_bin, surface_type, count(*) AS n FROM obs WHERE floor(t2m) BETWEEN 240 AND 300 AND floor(tcwv) BETWEEN 0 AND 76 GROUP BY ALL")
def s03(spark, sf):
    df = obs(spark, sf).withColumns({"t2m_bin": F.floor("t2m").cast("int"), "tcwv_bin": F.floor("tcwv").cast("int")})
    return df.where("t2m_bin between 240 and 300 and tcwv_bin between 0 and 76").groupBy("t2m_bin", "tcwv_bin", "surface_type").agg(F.count("*").alias("n"))


@query("o03_top_k", f"WITH {OBS_SQL} SELECT surface_type, sample_id, rank FROM (SELECT surface_type, sample_id, row_number() OVER (PARTITION BY surface_type ORDER BY surface_precip DESC NULLS LAST, sample_id)::INT AS rank FROM obs) WHERE rank <= 8")
def o03(spark, sf):
    w = Window.partitionBy("surface_type").orderBy(F.desc_nulls_last("surface_precip"), "sample_id")
    return obs(spark, sf).select("surface_type", "sample_id", F.row_number().over(w).alias("rank")).where("rank <= 8")


@query("o05_expected_resampling", f"WITH {OBS_SQL}, w AS (SELECT granule, scan, max(0, 90 - abs(avg(latitude))) AS w FROM obs GROUP BY ALL) SELECT granule, scan, round(w / sum(w) OVER (PARTITION BY granule) * 40, 6) AS expected FROM w".replace("max(0, ", "greatest(0, "))
def o05(spark, sf):
    w = obs(spark, sf).groupBy("granule", "scan").agg(F.greatest(F.lit(0.0), 90 - F.abs(F.avg("latitude"))).alias("w"))
    return rounded(w.select("granule", "scan", (F.col("w") / F.sum("w").over(Window.partitionBy("granule")) * 40).alias("expected")))


@query("o07_scene_tiles", f"WITH {OBS_SQL} SELECT granule, scan // 16 AS scene, count(*) AS n, round(avg(tcwv), 6) AS tcwv FROM obs WHERE scan // 16 < 2 GROUP BY ALL")
def o07(spark, sf):
    return rounded(obs(spark, sf).withColumn("scene", F.expr("scan div 16")).where("scene < 2").groupBy("granule", "scene").agg(F.count("*").alias("n"), F.avg("tcwv").alias("tcwv")))


@query("o09_split", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN day(o_orderdate) <= 3 THEN 'test' WHEN day(o_orderdate) <= 5 THEN 'validation' ELSE 'training' END AS split FROM orders) GROUP BY split")
def o09(spark, sf):
    return table(spark, sf, "orders").select(seq.split_by_day(F.col("o_orderdate")).alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@query("u01_union_missing", f"WITH {OBS_SQL} SELECT sample_id, tcwv, NULL::DOUBLE AS t2m FROM obs WHERE grp = 'a' UNION ALL SELECT sample_id, NULL, t2m FROM obs WHERE grp = 'b'")
def u01(spark, sf):
    df = obs(spark, sf)
    return df.where("grp = 'a'").select("sample_id", "tcwv").unionByName(df.where("grp = 'b'").select("sample_id", "t2m"), allowMissingColumns=True)


@query("u02_distinct_sources", f"WITH {OBS_SQL} SELECT granule FROM obs WHERE grp = 'a' UNION SELECT granule FROM obs WHERE grp = 'b'")
def u02(spark, sf):
    df = obs(spark, sf)
    return df.where("grp = 'a'").select("granule").union(df.where("grp = 'b'").select("granule")).distinct()


@query("u04_missing_samples", f"WITH {OBS_SQL} SELECT sample_id FROM obs WHERE sample_id NOT IN (SELECT sample_id FROM obs WHERE surface_precip IS NOT NULL AND surface_precip_ref IS NOT NULL)")
def u04(spark, sf):
    df = obs(spark, sf)
    return df.select("sample_id").join(df.dropna(subset=["surface_precip", "surface_precip_ref"]), "sample_id", "left_anti")


@query("g10_tile_assembly", f"WITH {OBS_SQL} SELECT granule, pixel, scan, round(tcwv, 6) AS tcwv FROM obs")
def g10(spark, sf):
    return rounded(seq.assemble(obs(spark, sf).select("granule", "pixel", "scan", "tcwv"), ["granule", "pixel"], "scan", "tcwv", 40, 16, 4))


@query("p06_region_scans", f"WITH {OBS_SQL} SELECT granule, scan, bool_or(longitude >= -60 AND longitude < 60 AND latitude >= -30 AND latitude < 30) AS inside FROM obs GROUP BY ALL")
def p06(spark, sf):
    return obs(spark, sf).groupBy("granule", "scan").agg(F.bool_or(F.expr("longitude >= -60 and longitude < 60 and latitude >= -30 and latitude < 30")).alias("inside"))


@query("p05_subset", f"WITH {OBS_SQL} SELECT sample_id, CASE WHEN tcwv BETWEEN 10 AND 60 AND t2m BETWEEN 250 AND 300 AND surface_type BETWEEN 1 AND 12 THEN surface_precip END AS surface_precip FROM obs")
def p05(spark, sf):
    from orbitframe.functions.clean import within

    keep = within(F.col("tcwv"), 10, 60) & within(F.col("t2m"), 250, 300) & within(F.col("surface_type"), 1, 12)
    return obs(spark, sf).select("sample_id", F.when(keep, F.col("surface_precip")).alias("surface_precip"))


@query("p14_extend_pixels", f"WITH {OBS_SQL} SELECT o.granule, o.scan, g.p AS pixel, x.tcwv FROM (SELECT DISTINCT granule, scan FROM obs) o CROSS JOIN range(41) g(p) LEFT JOIN obs x ON x.granule = o.granule AND x.scan = o.scan AND x.pixel + 8 = g.p")
def p14(spark, sf):
    df = obs(spark, sf)
    grid = df.select("granule", "scan").distinct().withColumn("pixel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))))
    return grid.join(df.select("granule", "scan", (F.col("pixel") + 8).alias("pixel"), "tcwv"), ["granule", "scan", "pixel"], "left")


@query("k08_scan_layout", f"WITH {OBS_SQL}, r AS (SELECT sample_id, row_number() OVER (PARTITION BY granule ORDER BY sample_id) - 1 AS rn, count(*) OVER (PARTITION BY granule) AS n FROM obs) SELECT sample_id, rn // 64 AS scan, rn % 64 AS pixel FROM r WHERE rn < n // 64 * 64")
def k08(spark, sf):
    w = Window.partitionBy("granule")
    df = obs(spark, sf).select("sample_id", (F.row_number().over(w.orderBy("sample_id")) - 1).cast("long").alias("rn"), F.count("*").over(w).alias("n"))
    return df.where("rn < n div 64 * 64").select("sample_id", F.expr("rn div 64").alias("scan"), F.expr("rn % 64").alias("pixel"))
