"""Queries of profile compression, table lookups, resized rows and fields smoothed by angle or class."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions.tables import frozen_precip, resize
from orbitframe.operators import fields, grid, profiles
from orbitframe.plans.registry import query
from orbitframe.plans.verification import rounded
from orbitframe.sources.fixtures import OBS_SQL, TB_SQL, obs, tb

CENTRES_SQL = """p AS (SELECT vec_id, vec_id % 4 AS k, list_transform(profile, lambda x: abs(x)) AS q FROM tb),
c AS (SELECT k, vec_id // 4 AS idx, list_transform(q, lambda x: x / list_sum(q)) AS centre FROM p WHERE vec_id < 40),
d AS (SELECT p.vec_id, p.k, p.q, list_sum(p.q) AS scale, c.idx, c.centre, list_sum(list_transform(range(1, 29), lambda i: (p.q[i] / list_sum(p.q) - c.centre[i]) ** 2)) / 28 AS mse FROM p JOIN c USING (k))"""


def _compressed(spark, sf):
    df = tb(spark, sf).select("vec_id", (F.col("vec_id") % 4).alias("k"), F.transform("profile", F.abs).alias("q"))
    centres = df.where("vec_id < 40").select("k", F.expr("vec_id div 4").alias("idx"), profiles.normalised(F.col("q")).alias("centre"))
    return profiles.compress(df, centres, "k", "q"), centres


@query("r07_compress_profile", f"WITH {TB_SQL}, {CENTRES_SQL} SELECT vec_id, round(any_value(scale), 6) AS scale, arg_min(idx, mse) AS idx, round(min(mse), 9) AS mse FROM d GROUP BY vec_id")
def r07(spark, sf):
    return _compressed(spark, sf)[0].select("vec_id", F.round("scale", 6).alias("scale"), "idx", F.round("mse", 9).alias("mse"))


@query("r08_profile_index", f"WITH {TB_SQL}, {CENTRES_SQL}, b AS (SELECT vec_id, any_value(scale) AS scale, arg_min(idx, mse) AS idx FROM d GROUP BY vec_id) SELECT vec_id, idx + 1 + CASE WHEN scale > 2.5 THEN 0 ELSE 40 END AS code FROM b")
def r08(spark, sf):
    return _compressed(spark, sf)[0].select("vec_id", (F.col("idx") + 1 + F.when(F.col("scale") > 2.5, 0).otherwise(40)).alias("code"))


@query("r09_decode_profile", f"WITH {TB_SQL}, {CENTRES_SQL}, b AS (SELECT vec_id, any_value(scale) AS scale, arg_min(centre, mse) AS centre FROM d GROUP BY vec_id) SELECT vec_id, round(scale * centre[1], 6) AS lowest, round(scale * centre[28], 6) AS highest FROM b")
def r09(spark, sf):
    out = profiles.decode(*_compressed(spark, sf), "k")
    return rounded(out.select("vec_id", F.get("decoded", F.lit(0)).alias("lowest"), F.get("decoded", F.lit(27)).alias("highest")))


OCEAN, LAND = [100 * i / 13 for i in range(14)], [100 * (i / 13) ** 2 for i in range(14)]


@query(
    "f16_frozen_precip",
    f"WITH {OBS_SQL}, t AS (SELECT sample_id, surface_type, surface_precip, greatest(least(t2m - 273.15::DOUBLE + 6.5, 13), 0) AS place FROM obs), k AS (SELECT *, least(floor(place), 12) AS low FROM t), "
    "f AS (SELECT *, CASE WHEN surface_type = 1 THEN 100 * place / 13 ELSE 100 * ((low / 13) ** 2 * (1 - (place - low)) + ((low + 1) / 13) ** 2 * (place - low)) END AS liquid FROM k) "
    "SELECT sample_id, round(CASE WHEN surface_precip >= 0 THEN (1 - liquid / 100) * surface_precip END + 1e-9, 6) AS frozen FROM f",
)
def f16(spark, sf):
    frozen = frozen_precip(F.col("t2m") - 273.15, F.col("surface_type"), F.col("surface_precip"), -6.5, 1.0, OCEAN, LAND)
    return rounded(obs(spark, sf).select("sample_id", frozen.alias("frozen")), 1e-9)


@query("g05_resize_rows", f"WITH {TB_SQL} SELECT vec_id, list_transform(range(29), lambda j: round(CASE WHEN j % 2 = 0 THEN tb[j // 2 + 1] ELSE (tb[j // 2 + 1] + tb[j // 2 + 2]) / 2 END, 6)) AS tb FROM tb")
def g05(spark, sf):
    return tb(spark, sf).select("vec_id", F.transform(resize(F.col("tb"), 15, 29), lambda v: F.round(v, 6)).alias("tb"))


ANGLED = "k AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(3) a, range(3) b), v AS (SELECT sample_id, granule, scan, pixel, surface_precip AS p, ((sample_id * 37) % 181)::DOUBLE / 18 AS f FROM obs WHERE surface_precip IS NOT NULL), t AS (SELECT *, least(floor(f % 10), 9) AS low, f % 10 AS g FROM v)"
WEIGHT = "exp(-0.5 * ((dx * cos(radians(({k}) * 18 - 90)) + dy * sin(radians(({k}) * 18 - 90))) ** 2 / 0.64 + (dy * cos(radians(({k}) * 18 - 90)) - dx * sin(radians(({k}) * 18 - 90))) ** 2 / 2.25))"


@query(
    "g03_smooth_by_angle",
    f"WITH {OBS_SQL}, {ANGLED}, w AS (SELECT t.sample_id, t.g - t.low AS part, n.p, {WEIGHT.format(k='t.low')} AS w0, {WEIGHT.format(k='t.low + 1')} AS w1 FROM t, k JOIN v n ON n.granule = t.granule AND n.scan = t.scan + k.dy AND n.pixel = t.pixel + k.dx) "
    "SELECT sample_id, round((1 - any_value(part)) * sum(w0 * p) / sum(w0) + any_value(part) * sum(w1 * p) / sum(w1), 6) AS smooth FROM w GROUP BY sample_id",
)
def g03(spark, sf):
    df = obs(spark, sf).withColumn("angle", ((F.col("sample_id") * 37) % 181 - 90).cast("double"))
    out = fields.smooth_rotated(df, ["granule"], "scan", "pixel", "surface_precip", "angle", 1.5, 0.8, 1)
    return rounded(df.select("sample_id", "granule", "scan", "pixel").join(out, ["granule", "scan", "pixel"]).select("sample_id", "smooth"))


@query(
    "g04_smooth_classes",
    f"WITH {OBS_SQL}, k AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx, exp(-((a.range - 1) ** 2 + (b.range - 1) ** 2) / 2.0::DOUBLE) AS w FROM range(3) a, range(3) b), "
    "c AS (SELECT sample_id, granule, scan, pixel, CASE WHEN sample_id % 23 = 0 THEN -1 ELSE (1 + (sample_id * 7919) % 11 // 4)::INT END AS code FROM obs), "
    "s AS (SELECT granule, scan + dy AS scan, pixel + dx AS pixel, code AS other, sum(w) AS w FROM c, k WHERE code >= 0 GROUP BY ALL), "
    "m AS (SELECT c.sample_id, c.code, s.other, s.w, row_number() OVER (PARTITION BY c.sample_id ORDER BY round(s.w, 9) DESC, s.other) AS r, round(s.w / sum(s.w) OVER (PARTITION BY c.sample_id), 9) AS share FROM c LEFT JOIN s USING (granule, scan, pixel)) "
    "SELECT sample_id, CASE WHEN code < 0 THEN -1 WHEN share >= 0.5 THEN other ELSE 0 END::INT AS smooth FROM m WHERE r = 1",
)
def g04(spark, sf):
    code = F.when(F.col("sample_id") % 23 == 0, -1).otherwise(F.expr("cast(1 + (sample_id * 7919) % 11 div 4 as int)"))
    df = obs(spark, sf).withColumn("code", code)
    out = fields.smooth_classes(df, ["granule"], "scan", "pixel", "code", grid.gaussian(1, 1.0))
    return df.select("sample_id", "granule", "scan", "pixel").join(out, ["granule", "scan", "pixel"]).select("sample_id", "smooth")


@query("g14_haar_energy", f"WITH {OBS_SQL}, e AS (SELECT granule, sum(surface_precip ** 2) AS energy FROM obs WHERE pixel < 24 GROUP BY granule) SELECT granule, level::INT AS level, round(energy, 4) AS energy FROM e, range(1, 4) l(level)")
def g14(spark, sf):
    """The packets keep the energy at every level."""
    out = fields.packet_energy(obs(spark, sf), "granule", "scan", "pixel", "surface_precip", 3)
    return out.groupBy("granule", "level").agg(F.round(F.sum("energy"), 4).alias("energy"))
