"""Queries of the mergeable statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.functions.bins import log_bin, uniform_bin
from orbitframe.operators import stats
from orbitframe.plans.registry import query
from orbitframe.plans.verification import _bin, rounded
from orbitframe.sources.fixtures import HIST_SQL, OBS_SQL, TB_SQL, histogram_input, obs, tb


def ubin(c: str, lo: float, hi: float, n: int) -> str:
    w = (hi - lo) / n
    return f"CASE WHEN {c} >= {lo} AND {c} < {hi} THEN floor(({c} - ({lo})) / {w})::INT WHEN {c} = {hi} THEN {n - 1} END"


@query("a10_scan_position_mean", f"WITH {OBS_SQL} SELECT pixel, round(avg(coalesce(surface_precip, 0)), 6) AS mean, count(*) AS n FROM obs GROUP BY pixel")
def a10(spark, sf):
    return rounded(stats.scan_position_mean(obs(spark, sf), "surface_precip"))


@query("a11_zonal_mean", f"WITH {OBS_SQL}, b AS (SELECT month(scan_time)::INT AS month, {ubin('latitude', -90., 90., 180)} AS lat_bin, surface_precip AS v FROM obs) SELECT month, lat_bin, count(*) AS n, round(sum(v), 6) AS total, round(sum(v) / count(*), 6) AS mean FROM b WHERE lat_bin IS NOT NULL AND v IS NOT NULL GROUP BY ALL")
def a11(spark, sf):
    return rounded(stats.finish(stats.partial(obs(spark, sf), {"month": F.month("scan_time"), "lat_bin": uniform_bin(F.col("latitude"), -90.0, 90.0, 180)}, F.col("surface_precip"))))


@query("a11_zonal_histogram", f"WITH {OBS_SQL}, b AS (SELECT {ubin('latitude', -90., 90., 180)} AS lat_bin, {_bin('surface_precip', .01, 316.22776601683796, 200)} AS bin FROM obs) SELECT lat_bin, bin, count(*) AS n FROM b WHERE lat_bin IS NOT NULL AND bin IS NOT NULL GROUP BY ALL")
def a11h(spark, sf):
    return stats.partial(obs(spark, sf), {"lat_bin": uniform_bin(F.col("latitude"), -90.0, 90.0, 180), "bin": log_bin(F.col("surface_precip"), 0.01, 316.22776601683796, 200)})


CELL = {"lat_bin": ("latitude", -90.0, 90.0, 36), "lon_bin": ("longitude", -180.0, 180.0, 72)}


def cells():
    return {k: uniform_bin(F.col(c), lo, hi, n) for k, (c, lo, hi, n) in CELL.items()}


CELLS = ", ".join(f"{ubin(c, lo, hi, n)} AS {k}" for k, (c, lo, hi, n) in CELL.items())


@query("a12_grid_mean", f"WITH {OBS_SQL}, b AS (SELECT {CELLS}, surface_precip AS v FROM obs) SELECT lat_bin, lon_bin, count(*) AS n, round(sum(v), 6) AS total, round(avg(v), 6) AS mean FROM b WHERE v >= 0 GROUP BY ALL")
def a12(spark, sf):
    return rounded(stats.finish(stats.partial(obs(spark, sf), cells(), F.when(F.col("surface_precip") >= 0, F.col("surface_precip")))))


@query("a12_grid_histogram", f"WITH {OBS_SQL}, b AS (SELECT {CELLS}, {_bin('surface_precip', .01, 100., 100)} AS bin FROM obs) SELECT lat_bin, lon_bin, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL")
def a12h(spark, sf):
    return stats.partial(obs(spark, sf), cells() | {"bin": log_bin(F.col("surface_precip"), 0.01, 100.0, 100)})


@query("a13_global_targets", f"WITH {OBS_SQL}, l AS (SELECT latitude, longitude, unnest(['surface_precip','surface_precip_ref','tcwv']) AS target, unnest([surface_precip, surface_precip_ref, tcwv]) AS value FROM obs), b AS (SELECT target, {CELLS}, value FROM l) SELECT target, lat_bin, lon_bin, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM b WHERE value IS NOT NULL GROUP BY ALL")
def a13(spark, sf):
    long = stats.unpivot_targets(obs(spark, sf), ["latitude", "longitude"], ["surface_precip", "surface_precip_ref", "tcwv"])
    return rounded(stats.finish(stats.partial(long, {"target": F.col("target")} | cells(), F.col("value"))))


@query("a14_positional_zonal", f"WITH {OBS_SQL}, b AS (SELECT pixel, {ubin('latitude', -90., 90., 180)} AS lat_bin, surface_precip AS v FROM obs) SELECT pixel, lat_bin, count(*) AS n, round(sum(v), 6) AS total FROM b WHERE v IS NOT NULL GROUP BY ALL")
def a14(spark, sf):
    return rounded(stats.partial(obs(spark, sf), {"pixel": F.col("pixel"), "lat_bin": uniform_bin(F.col("latitude"), -90.0, 90.0, 180)}, F.col("surface_precip")))


@query("a15_tb_histogram", f"WITH {TB_SQL}, l AS (SELECT surface_type, unnest(tb) AS v, unnest(range(15))::INT AS channel FROM tb), b AS (SELECT surface_type, channel, {ubin('v', 0., 400., 400)} AS tb_bin FROM l) SELECT surface_type, channel, tb_bin, count(*) AS n FROM b WHERE tb_bin IS NOT NULL GROUP BY ALL")
def a15(spark, sf):
    long = tb(spark, sf).select("surface_type", F.posexplode("tb").alias("channel", "v"))
    return stats.partial(long, {"surface_type": F.col("surface_type"), "channel": F.col("channel"), "tb_bin": uniform_bin(F.col("v"), 0.0, 400.0, 400)})


@query("a15_tb_tcwv_histogram", f"WITH {HIST_SQL}, b AS (SELECT surface_type, channel, {ubin('tcwv', 0., 100., 100)} AS tcwv_bin, {ubin('tb', 0., 400., 400)} AS tb_bin FROM hist) SELECT surface_type, channel, tcwv_bin, tb_bin, count(*) AS n FROM b WHERE tcwv_bin IS NOT NULL AND tb_bin IS NOT NULL GROUP BY ALL")
def a15j(spark, sf):
    return stats.partial(histogram_input(spark, sf), {"surface_type": F.col("surface_type"), "channel": F.col("channel"), "tcwv_bin": uniform_bin(F.col("tcwv"), 0.0, 100.0, 100), "tb_bin": uniform_bin(F.col("tb"), 0.0, 400.0, 400)})


def _one(name: str, column: str, lo: float, hi: float, n: int):
    @query(f"a16_{name}_histogram", f"WITH {OBS_SQL}, b AS (SELECT surface_type, {ubin(column, lo, hi, n)} AS bin FROM obs) SELECT surface_type, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL")
    def run(spark, sf):
        return stats.partial(obs(spark, sf), {"surface_type": F.col("surface_type"), "bin": uniform_bin(F.col(column), lo, hi, n)})


_one("t2m", "t2m", 240.0, 340.0, 200)
_one("tcwv", "tcwv", 0.0, 100.0, 100)


@query("a16_conditional_mean", f"WITH {OBS_SQL}, b AS (SELECT surface_type, {ubin('t2m', 240., 340., 200)} AS t2m_bin, surface_precip AS v FROM obs WHERE surface_precip > -999) SELECT surface_type, t2m_bin, count(*) AS n, round(sum(v), 6) AS total, round(avg(v), 6) AS mean FROM b WHERE t2m_bin IS NOT NULL GROUP BY ALL")
def a16c(spark, sf):
    return rounded(stats.finish(stats.partial(obs(spark, sf), {"surface_type": F.col("surface_type"), "t2m_bin": uniform_bin(F.col("t2m"), 240.0, 340.0, 200)}, F.col("surface_precip"))))


@query("a17_airmass_surface", f"WITH {OBS_SQL} SELECT surface_type, airmass_type, count(*) AS n FROM obs WHERE latitude BETWEEN -65.5 AND 65.5 GROUP BY GROUPING SETS ((surface_type), (airmass_type), (surface_type, airmass_type))")
def a17(spark, sf):
    df = obs(spark, sf).where(F.col("latitude").between(-65.5, 65.5))
    return df.groupingSets([["surface_type"], ["airmass_type"], ["surface_type", "airmass_type"]], "surface_type", "airmass_type").agg(F.count("*").alias("n"))


@query("a17_local_time_histogram", f"WITH {OBS_SQL}, b AS (SELECT {ubin('latitude', -90., 90., 180)} AS lat_bin, hour(scan_time + to_seconds(trunc(longitude * 240)::INT))::INT AS hour FROM obs) SELECT lat_bin, hour, count(*) AS n FROM b GROUP BY ALL")
def a17l(spark, sf):
    return stats.partial(obs(spark, sf), {"lat_bin": uniform_bin(F.col("latitude"), -90.0, 90.0, 180), "hour": F.hour(F.expr("timestampadd(SECOND, cast(longitude * 240 as int), scan_time)"))})


@query("a18_profile_statistics", f"WITH {TB_SQL} SELECT surface_type, count(*) AS n, round(sum(list_sum(profile)), 6) AS total FROM tb WHERE list_min(profile) > -999 GROUP BY surface_type")
def a18(spark, sf):
    df = tb(spark, sf).where(F.forall("profile", lambda x: x > -999))
    return rounded(stats.partial(df, {"surface_type": F.col("surface_type")}, F.aggregate("profile", F.lit(0.0), lambda a, x: a + x)))


@query("a01_merge_doubles", f"WITH {OBS_SQL} SELECT surface_type, 2 * count(*) AS n, round(2 * sum(surface_precip), 6) AS total FROM obs WHERE surface_precip IS NOT NULL GROUP BY surface_type")
def a01(spark, sf):
    one = stats.partial(obs(spark, sf), {"surface_type": F.col("surface_type")}, F.col("surface_precip"))
    return rounded(stats.merge(one, one)).withColumn("n", F.col("n").cast("long"))


@query("a41_feature_limits", f"WITH {TB_SQL}, l AS (SELECT unnest(tb) AS v, unnest(range(15))::INT AS feature FROM tb) SELECT feature, round(min(v), 6) AS low, round(max(v), 6) AS high FROM l GROUP BY feature")
def a41(spark, sf):
    return rounded(tb(spark, sf).select(F.posexplode("tb").alias("feature", "v")).groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high")))


@query("a42_cdf", f"WITH {HIST_SQL}, b AS (SELECT surface_type, channel, {ubin('tb', 0., 400., 400)} AS tb_bin, count(*) AS n FROM hist GROUP BY ALL) SELECT surface_type, channel, tb_bin, round(sum(n) OVER (PARTITION BY surface_type, channel ORDER BY tb_bin) / sum(n) OVER (PARTITION BY surface_type, channel), 6) AS cdf FROM b WHERE tb_bin IS NOT NULL")
def a42(spark, sf):
    from orbitframe.operators.sequence import cdf

    h = stats.partial(histogram_input(spark, sf), {"surface_type": F.col("surface_type"), "channel": F.col("channel"), "tb_bin": uniform_bin(F.col("tb"), 0.0, 400.0, 400)})
    return rounded(cdf(h, ["surface_type", "channel"], "tb_bin", "n").drop("n"))


@query("a43_valid_fraction", f"WITH {OBS_SQL} SELECT granule, scan // 8 AS tile, count(surface_precip) AS n_valid, round(min(rqi), 6) AS min_rqi, bool_and(surface_type >= 1) AS all_surface FROM obs GROUP BY ALL")
def a43(spark, sf):
    return rounded(obs(spark, sf).groupBy("granule", F.expr("scan div 8").alias("tile")).agg(F.count("surface_precip").alias("n_valid"), F.min("rqi").alias("min_rqi"), F.bool_and(F.col("surface_type") >= 1).alias("all_surface")))


C = "SELECT surface_type, tb_bin, n, sum(n) OVER (PARTITION BY surface_type ORDER BY tb_bin) / sum(n) OVER (PARTITION BY surface_type) AS cdf FROM"
FIT = f"""WITH {HIST_SQL}, b AS (SELECT surface_type, channel, {ubin('tb', 0., 400., 400)} AS tb_bin FROM hist),
 o AS ({C} (SELECT surface_type, tb_bin, count(*) AS n FROM b WHERE channel % 2 = 1 AND tb_bin IS NOT NULL GROUP BY ALL)), s AS ({C} (SELECT surface_type, tb_bin, count(*) AS n FROM b WHERE channel % 2 = 0 AND tb_bin IS NOT NULL GROUP BY ALL)),
 t AS (SELECT surface_type, tb_bin::DOUBLE AS hi, cdf AS c1, coalesce(lag(tb_bin) OVER w, tb_bin)::DOUBLE AS lo, coalesce(lag(cdf) OVER w, 0) AS c0 FROM o WINDOW w AS (PARTITION BY surface_type ORDER BY tb_bin)),
 f AS (SELECT s.surface_type, s.tb_bin, lo + (hi - lo) * (s.cdf - c0) / (c1 - c0) - s.tb_bin AS delta FROM s JOIN t ON s.surface_type = t.surface_type AND s.cdf > c0 AND s.cdf <= c1)"""


def _fit(spark, sf):
    from orbitframe.operators import correct

    h = histogram_input(spark, sf)
    part = lambda c: stats.partial(h.where(F.col("channel") % 2 == c), {"surface_type": F.col("surface_type"), "tb_bin": uniform_bin(F.col("tb"), 0.0, 400.0, 400)})
    return correct.fit(part(1), part(0), ["surface_type"], "tb_bin", "n")


@query("f26_cdf_correction", FIT + " SELECT surface_type, tb_bin, round(delta + 1e-9, 6) AS delta FROM f")
def f26(spark, sf):
    return rounded(_fit(spark, sf), 1e-9)


@query("f25_corrected_mean", FIT + ", x AS (SELECT surface_type, tb_bin FROM b WHERE channel % 2 = 0 AND tb_bin IS NOT NULL) SELECT x.surface_type, count(*) AS n, round(avg(x.tb_bin + CASE WHEN x.surface_type IN (2, 8, 9, 10, 11, 16) THEN 0 ELSE coalesce(f.delta, 0) END), 6) AS tb FROM x LEFT JOIN f ON f.surface_type = x.surface_type AND f.tb_bin = x.tb_bin GROUP BY x.surface_type")
def f25(spark, sf):
    from orbitframe.operators import correct

    x = histogram_input(spark, sf).where("channel % 2 = 0").select("surface_type", uniform_bin(F.col("tb"), 0.0, 400.0, 400).alias("tb_bin")).dropna().withColumn("tb", F.col("tb_bin").cast("double"))
    return rounded(correct.apply(x, _fit(spark, sf), ["surface_type"], "tb_bin", "tb").groupBy("surface_type").agg(F.count("*").alias("n"), F.avg("tb").alias("tb")))


PRESET = {
    "zonal": (["month", "lat_bin"], "month(scan_time)::INT", ubin("latitude", -90.0, 90.0, 180)),
    "surface": (["surface_type", "airmass"], "surface_type", "airmass_type"),
    "pixels": (["pixel", "half"], "pixel::INT", "(scan // 20)::INT"),
}
PRESET_SQL = " UNION ALL ".join(f"SELECT '{name}' AS statistic, {one} AS k0, {two} AS k1, count(*) AS n, round(sum(surface_precip) + 1e-9, 6) AS total FROM obs WHERE surface_precip IS NOT NULL AND ({two}) IS NOT NULL GROUP BY ALL" for name, (_, one, two) in PRESET.items())


@query("a03_preset_bundle", f"WITH {OBS_SQL} {PRESET_SQL}")
def a03(spark, sf):
    """Three statistics of one scan."""
    keys = {
        "zonal": [F.month("scan_time"), uniform_bin(F.col("latitude"), -90.0, 90.0, 180)],
        "surface": [F.col("surface_type"), F.col("airmass_type")],
        "pixels": [F.col("pixel"), F.expr("scan div 20")],
    }
    return rounded(stats.bundle(obs(spark, sf), keys, F.col("surface_precip")), 1e-9)
