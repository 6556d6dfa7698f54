"""Queries of draws, selections, batches and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitframe.operators import sampling as sm
from orbitframe.plans.registry import query
from orbitframe.plans.verification import rounded
from orbitframe.sources.fixtures import OBS_SQL, TB_SQL, obs, table, tb

NEDT = [0.5 + 0.1 * k for k in range(15)]


def draw_sql(key: str, seed: str) -> str:
    return f"((((({key}) * 7919 + ({seed}) * 104729) % 100003)::DOUBLE + 0.5) / 100003.0::DOUBLE)"


def normal_sql(key: str, seed: str) -> str:
    return f"(sqrt(-2 * ln({draw_sql(key, seed)})) * cos(2 * pi() * {draw_sql(key, f'({seed}) + 1')}))"


@query("f12_thermal_noise", f"WITH {TB_SQL} SELECT vec_id, list_transform(range(1, 16), lambda i: round(tb[i] + (0.4::DOUBLE + 0.1::DOUBLE * i) * {normal_sql('vec_id', '3 + 2 * (i - 1)')}, 6)) AS tb FROM tb")
def f12(spark, sf):
    noisy = sm.noise(F.col("tb"), NEDT, F.col("vec_id"), 3, sm.arithmetic)
    return tb(spark, sf).select("vec_id", F.transform(noisy, lambda t: F.round(t, 6)).alias("tb"))


@query("f13_channel_dropout", f"WITH {TB_SQL} SELECT vec_id, list_transform(range(1, 16), lambda i: CASE WHEN {draw_sql('vec_id * 64 + i - 1', '5')} >= 0.2 THEN round(tb[i], 6) END) AS tb FROM tb")
def f13(spark, sf):
    return tb(spark, sf).select("vec_id", F.transform(sm.dropout(F.col("tb"), 0.2, F.col("vec_id"), 5, sm.arithmetic), lambda t: F.round(t, 6)).alias("tb"))


@query("f13_masked_edges", f"WITH {OBS_SQL}, w AS (SELECT *, floor({draw_sql('granule', '7')} * 9) AS width, {draw_sql('granule', '8')} < 0.5 AS lhs FROM obs) SELECT sample_id, CASE WHEN NOT (CASE WHEN lhs THEN pixel < width ELSE pixel >= 25 - width END) THEN tcwv END AS tcwv FROM w")
def f13e(spark, sf):
    return obs(spark, sf).select("sample_id", sm.mask_edges(F.col("tcwv"), F.col("pixel"), 25, 8, F.col("granule"), 7, sm.arithmetic).alias("tcwv"))


@query("f14_zero_replacement", f"WITH {OBS_SQL} SELECT sample_id, round(CASE WHEN abs(surface_precip) <= 1e-3 THEN 10 ** (log10(1e-3::DOUBLE) - 4 + 4 * {draw_sql('sample_id', '9')}) ELSE surface_precip END, 10) AS surface_precip FROM obs")
def f14(spark, sf):
    return obs(spark, sf).select("sample_id", F.round(sm.replace_zeros(F.col("surface_precip"), 1e-3, F.col("sample_id"), 9, sm.arithmetic), 10).alias("surface_precip"))


@query("g16_flips", f"WITH {OBS_SQL} SELECT sample_id, CASE WHEN {draw_sql('granule', '11')} < 0.5 THEN 39 - scan ELSE scan END AS scan, CASE WHEN {draw_sql('granule', '12')} < 0.5 THEN 24 - pixel ELSE pixel END AS pixel FROM obs")
def g16(spark, sf):
    scan, pixel = sm.flips(F.col("scan"), F.col("pixel"), 40, 25, F.col("granule"), 11, sm.arithmetic)
    return obs(spark, sf).select("sample_id", scan.alias("scan"), pixel.alias("pixel"))


@query("p15_ablation", f"WITH {TB_SQL} SELECT vec_id, list_transform(range(1, 16), lambda i: CASE WHEN i NOT IN (3, 8, 15) THEN round(tb[i], 6) END) AS tb FROM tb")
def p15(spark, sf):
    return tb(spark, sf).select("vec_id", F.transform(sm.ablate(F.col("tb"), [2, 7, 14]), lambda t: F.round(t, 6)).alias("tb"))


@query("p15_permutation", f"WITH {OBS_SQL}, o AS (SELECT sample_id, granule, tcwv, row_number() OVER w AS r, count(*) OVER (PARTITION BY granule) AS n FROM obs WINDOW w AS (PARTITION BY granule ORDER BY {draw_sql('sample_id', '13')}, sample_id)) SELECT a.sample_id, b.tcwv FROM o a JOIN o b ON a.granule = b.granule AND b.r = a.r % a.n + 1")
def p15p(spark, sf):
    return sm.permute(obs(spark, sf).select("sample_id", "granule", "tcwv"), ["granule"], "sample_id", "tcwv", 13, sm.arithmetic).select("sample_id", "tcwv")


WEIGHTS = "w AS (SELECT granule, scan, greatest(0, 90 - abs(avg(latitude))) AS w FROM obs GROUP BY ALL)"


@query("o05_weighted_resampling", f"WITH {OBS_SQL}, {WEIGHTS}, b AS (SELECT *, sum(w) OVER (PARTITION BY granule ORDER BY scan) AS hi, sum(w) OVER (PARTITION BY granule) AS everything FROM w), d AS (SELECT granule, k.range::INT AS draw, {draw_sql('granule * 40 + k.range', '1')} AS u FROM (SELECT DISTINCT granule FROM w), range(40) k) SELECT b.granule, b.scan, d.draw FROM b JOIN d ON b.granule = d.granule AND u * everything >= hi - w AND u * everything < hi")
def o05(spark, sf):
    w = obs(spark, sf).groupBy("granule", "scan").agg(F.greatest(F.lit(0.0), 90 - F.abs(F.avg("latitude"))).alias("w"))
    return sm.resample(w, ["granule"], "scan", "w", 40, F.col("granule"), 1, sm.arithmetic)


@query("o06_scenes")
def o06(spark, sf):
    return sm.scenes(obs(spark, sf), "granule", "scan", "pixel", "surface_precip", 16, 20)


@query("o01_time_order", f"WITH {OBS_SQL} SELECT granule, list(scan ORDER BY first_time, scan) AS scans FROM (SELECT granule, scan, min(scan_time) AS first_time FROM obs GROUP BY ALL) GROUP BY granule")
def o01(spark, sf):
    scans = obs(spark, sf).groupBy("granule", "scan").agg(F.min("scan_time").alias("t"))
    return scans.groupBy("granule").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "scan"))), lambda s: s["scan"]).alias("scans"))


@query("o02_first_match", "SELECT o_custkey AS key, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_file FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def o02(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("key")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_file"))


@query("o02_first_hundred", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def o02h(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("o04_shuffle", f"WITH {OBS_SQL} SELECT granule, sample_id, (row_number() OVER (PARTITION BY granule ORDER BY {draw_sql('sample_id', '17')}, sample_id))::INT AS place FROM obs")
def o04(spark, sf):
    w = Window.partitionBy("granule").orderBy(sm.arithmetic(F.col("sample_id"), 17), "sample_id")
    return obs(spark, sf).select("granule", "sample_id", F.row_number().over(w).alias("place"))


@query("o08_batches", f"WITH {OBS_SQL}, r AS (SELECT granule, (row_number() OVER (PARTITION BY granule ORDER BY sample_id) - 1) // 64 AS batch, sample_id FROM obs) SELECT granule, batch, count(*) AS n, min(sample_id) AS first_id, max(sample_id) AS last_id FROM r GROUP BY ALL")
def o08(spark, sf):
    r = F.row_number().over(Window.partitionBy("granule").orderBy("sample_id")) - 1
    rows = obs(spark, sf).select("granule", "sample_id", r.cast("long").alias("r")).withColumn("batch", F.expr("r div 64"))
    return rows.groupBy("granule", "batch").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"))


@query("p09_valid_scans", f"WITH {OBS_SQL}, v AS (SELECT granule, min(scan) AS lo, max(scan) AS hi FROM obs WHERE surface_precip > 20 AND mask < 90 AND scan BETWEEN 3 AND 33 GROUP BY granule) SELECT sample_id, scan - lo AS scan FROM obs JOIN v USING (granule) WHERE scan BETWEEN lo AND hi")
def p09(spark, sf):
    df = obs(spark, sf)
    span = df.where("surface_precip > 20 and mask < 90 and scan between 3 and 33").groupBy("granule").agg(F.min("scan").alias("lo"), F.max("scan").alias("hi"))
    return df.join(span, "granule").where("scan between lo and hi").select("sample_id", (F.col("scan") - F.col("lo")).alias("scan"))


@query("p11_drop_rename", f"WITH {TB_SQL} SELECT vec_id, list_transform(tb, lambda t: round(t, 6)) AS brightness_temperatures_gmi FROM tb")
def p11(spark, sf):
    df = tb(spark, sf).drop("profile", "surface_type").withColumnRenamed("tb", "brightness_temperatures_gmi")
    return df.withColumn("brightness_temperatures_gmi", F.transform("brightness_temperatures_gmi", lambda t: F.round(t, 6)))


@query("r03_features", f"WITH {TB_SQL} SELECT vec_id, list_concat(list_transform(tb, lambda t: round(t, 6)), list_transform(range(1, 19), lambda i: CASE WHEN i = surface_type + 1 THEN 1.0::DOUBLE ELSE 0.0 END)) AS x, (surface_type + 1)::INT AS surface_type FROM tb")
def r03(spark, sf):
    one_hot = F.transform(F.sequence(F.lit(1), F.lit(18)), lambda i: (i == F.col("surface_type") + 1).cast("double"))
    df = tb(spark, sf).select("vec_id", F.concat(F.transform("tb", lambda t: F.round(t, 6)), one_hot).alias("x"))
    # and split again: the class is where the second part has its one
    return df.select("vec_id", "x", F.array_position(F.slice("x", 16, 18), 1.0).cast("int").alias("surface_type"))


@query("f09_output_names", f"WITH {OBS_SQL}, g AS (SELECT granule, min(scan_time) AS t0, max(scan_time) AS t1 FROM obs GROUP BY granule) SELECT granule, '2A.NET1D.GMI.V0.' || strftime(t0, '%Y%m%d') || '-S' || strftime(t0, '%H%M%S') || '-E' || strftime(t1, '%H%M%S') || '.' || lpad(granule::VARCHAR, 6, '0') || '.BIN' AS name FROM g")
def f09(spark, sf):
    g = obs(spark, sf).groupBy("granule").agg(F.min("scan_time").alias("t0"), F.max("scan_time").alias("t1"))
    name = F.concat(F.lit("2A.NET1D.GMI.V0."), F.date_format("t0", "yyyyMMdd"), F.lit("-S"), F.date_format("t0", "HHmmss"), F.lit("-E"), F.date_format("t1", "HHmmss"), F.lit("."), F.lpad(F.col("granule").cast("string"), 6, "0"), F.lit(".BIN"))
    return g.select("granule", name.alias("name"))


@query("a40_poisson_bootstrap", f"WITH {OBS_SQL}, k AS (SELECT o.surface_precip AS v, r.range::INT AS turn, {draw_sql('o.sample_id', '100 + r.range')} AS u FROM obs o, range(8) r WHERE surface_precip IS NOT NULL), w AS (SELECT turn, v, CASE WHEN u < exp(-1) THEN 0 WHEN u < 2 * exp(-1) THEN 1 WHEN u < 2.5 * exp(-1) THEN 2 WHEN u < (8 / 3::DOUBLE) * exp(-1) THEN 3 WHEN u < (65 / 24::DOUBLE) * exp(-1) THEN 4 WHEN u < (163 / 60::DOUBLE) * exp(-1) THEN 5 ELSE 6 END AS w FROM k), m AS (SELECT turn, sum(w * v) / sum(w) AS m FROM w GROUP BY turn) SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM m")
def a40(spark, sf):
    from orbitframe.operators.verify import poisson_bootstrap

    return rounded(poisson_bootstrap(obs(spark, sf).where("surface_precip is not null"), "surface_precip", F.col("sample_id"), 8, 100, sm.arithmetic))
