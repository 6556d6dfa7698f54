"""Queries of the bundles of statistics, one for each kind of data, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.operators import presets
from orbitframe.plans.registry import query
from orbitframe.plans.statistics import ubin
from orbitframe.plans.verification import _bin, rounded
from orbitframe.sources import store
from orbitframe.sources.fixtures import OBS_SQL, TB_SQL, obs, tb

CHANNELS, CENTRE, ANGLES = 4, (8, 17), [60.0, 40.0, 10.0]

T2M, TCWV, LAT = ubin("t2m", 239.5, 339.5, 100), ubin("tcwv", -0.5, 99.5, 100), ubin("latitude", -90.0, 90.0, 180)
CELL5 = [ubin("latitude", -90.0, 90.0, 36), ubin("longitude", -180.0, 180.0, 72)]
RATE = _bin("surface_precip", 0.01, 316.22776601683796, 200)
HOUR = "hour(scan_time + to_seconds(trunc(longitude * 240)::INT))::INT"
TARGET_BIN = f"CASE WHEN target = 'latent_heat' THEN {ubin('v', -500.0, 500.0, 200)} ELSE {ubin('v', 0.0, 500.0, 200)} END"


def part(name: str, keys: list[str], source: str, target: str = "NULL", n: str = "count(*)", total: str = "NULL::DOUBLE", where: str = "TRUE") -> str:
    """One statistic in SQL."""
    cols = ", ".join(f"{k} AS k{i}" for i, k in enumerate([*keys, *["NULL::INT"] * (presets.KEYS - len(keys))]))
    there = " AND ".join(f"({k}) IS NOT NULL" for k in keys)
    return f"SELECT '{name}' AS statistic, {target} AS target, {cols}, ({n})::BIGINT AS n, {total} AS total FROM {source} WHERE {where} AND {there} GROUP BY ALL"


def means(name: str, keys: list[str], source: str = "v", where: str = "TRUE") -> str:
    return part(name, keys, source, "target", "sum(len(vals))", "sum(list_sum(vals))", f"len(vals) > 0 AND {where}")


def values(targets: dict[str, bool], source: str, whole: bool, columns: str = "*") -> str:
    """(target, vals, ...) of each target (name to whether it is a profile)."""
    some = "list_filter({t}, lambda x: x > -999)"
    all_ = f"CASE WHEN len({some}) = len({{t}}) THEN {some} ELSE [] END"
    one = lambda t, profile: (all_ if whole else some).format(t=t) if profile else f"CASE WHEN {t} > -999 THEN [{t}] ELSE [] END"
    return " UNION ALL ".join(f"SELECT '{t}' AS target, {one(t, p)} AS vals, {columns} FROM {source}" for t, p in targets.items())


def answer(ctes: str, parts: list[str]) -> str:
    return f"WITH {ctes}, u AS ({' UNION ALL '.join(parts)}) SELECT statistic, target, k0, k1, k2, k3, k4, n, round(total + 1e-9, 6) AS total, round(total / n + 1e-9, 6) AS mean FROM u"


SCENE_SQL = f"""{OBS_SQL}, r AS (SELECT granule, surface_type, airmass_type, latitude, longitude, scan_time, pixel, t2m, tcwv, surface_precip, surface_precip_ref AS rain_water_path,
    [tcwv, surface_precip, surface_precip_ref] AS rain_water_content, [surface_precip - 5, tcwv - 50] AS latent_heat, (sample_id % 70)::DOUBLE AS earth_incidence_angle,
    list_transform(range({CHANNELS}), lambda k: t2m - 3.0 * k) AS tb FROM obs)"""
SCENE_TARGETS = {"surface_precip": False, "rain_water_path": False, "rain_water_content": True, "latent_heat": True}


def _scenes(spark, sf):
    return obs(spark, sf).select(
        "granule", "surface_type", "airmass_type", "latitude", "longitude", "scan_time", "pixel", "t2m", "tcwv", "surface_precip", F.col("surface_precip_ref").alias("rain_water_path"),
        F.array("tcwv", "surface_precip", "surface_precip_ref").alias("rain_water_content"), F.array(F.col("surface_precip") - 5, F.col("tcwv") - 50).alias("latent_heat"),
        (F.col("sample_id") % 70).cast("double").alias("earth_incidence_angle"), F.array(*(F.col("t2m") - 3.0 * k for k in range(CHANNELS))).alias("tb"),
    )


ANCILLARY = [part("t2m", ["surface_type", T2M], "r"), part("tcwv", ["surface_type", TCWV], "r"), part("surface", ["surface_type"], "r"), part("airmass", ["airmass_type"], "r")]
TIMES = [part("latitude", [LAT], "r"), part("local_time", [HOUR], "r"), part("latitude_local_time", [LAT, HOUR], "r")]
MAPS = [means("zonal", [LAT]), part("zonal_histogram", [LAT, RATE], "r", "'surface_precip'"), means("global", CELL5), part("global_histogram", [*CELL5, RATE], "r", "'surface_precip'")]
ANGLE = "CASE WHEN earth_incidence_angle >= 50 AND earth_incidence_angle < 75 THEN 0 WHEN earth_incidence_angle >= 25 AND earth_incidence_angle < 50 THEN 1 WHEN earth_incidence_angle >= 0 AND earth_incidence_angle < 25 THEN 2 END"
HISTOGRAM = part("histogram", ["surface_type", "0", TARGET_BIN], "(SELECT target, surface_type, unnest(vals) AS v FROM v)", "target")


def channels(angle: str) -> str:
    return f"c AS (SELECT surface_type, latitude, tcwv, unnest(tb) AS x, unnest(range({CHANNELS}))::INT AS channel, {angle} AS angle FROM r)"


def tbs(where: str = "TRUE") -> list[str]:
    bin_ = ubin("x", 0.0, 400.0, 400)
    return [part("tb", ["surface_type", "channel", "angle", bin_], "c", where=where), part("tb_tcwv", ["surface_type", "channel", "angle", TCWV, bin_], "c", where=where)]


NARROW = "surface_type, tcwv, t2m, latitude, longitude, pixel"


@query("a03_training_bundle", answer(f"{SCENE_SQL}, {channels('0')}, v AS ({values(SCENE_TARGETS, 'r', False, NARROW)})", [*tbs(), HISTOGRAM, means("by_tcwv", ["surface_type", TCWV]), *ANCILLARY, *TIMES, *MAPS]))
def a03_training(spark, sf):
    """Channels, targets, ancillary data, times and maps of training pixels."""
    return rounded(presets.preset(_scenes(spark, sf), "training_1d"), 1e-9)


@query("a03_observation_bundle", answer(f"{SCENE_SQL}, {channels(ANGLE)}", [*tbs("latitude BETWEEN -65.5 AND 65.5"), part("t2m", ["surface_type", ubin("t2m", 240.0, 330.0, 200)], "r", where="latitude BETWEEN -65.5 AND 65.5"), part("tcwv", ["surface_type", TCWV], "r", where="latitude BETWEEN -65.5 AND 65.5"), *ANCILLARY[2:], *TIMES]))
def a03_observations(spark, sf):
    """Channels by the nearest of three viewing angles, in the latitudes of the reference sensor; times of all pixels."""
    return rounded(presets.preset(_scenes(spark, sf), "observations", angles=ANGLES), 1e-9)


RETRIEVED = [
    HISTOGRAM,
    means("by_t2m", ["surface_type", T2M]),
    means("by_tcwv", ["surface_type", TCWV]),
    means("by_tcwv_centre", ["surface_type", TCWV], where=f"pixel >= {CENTRE[0]} AND pixel < {CENTRE[1]}"),
    means("zonal", [LAT], "z"),
    MAPS[1],
    means("global", CELL5, "z"),
    MAPS[3],
    part("scan_position", ["pixel::INT"], "r", "'surface_precip'", total="sum(coalesce(surface_precip, 0))"),
]
RETRIEVAL_SQL = answer(f"{SCENE_SQL}, v AS ({values(SCENE_TARGETS, 'r', True, NARROW)}), z AS ({values(SCENE_TARGETS, 'r', False, NARROW)})", RETRIEVED)


@query("a18_retrieval_bundle", RETRIEVAL_SQL)
def a18_retrieval(spark, sf):
    """Targets by surface, temperature and water vapour, also for the middle of the swath; a profile counts only if all its layers are valid."""
    return rounded(presets.preset(_scenes(spark, sf), "retrieval", centre=CENTRE), 1e-9)


@query("k10_saved_statistics", RETRIEVAL_SQL)
def k10_saved(spark, sf):
    """The same bundle of two runs, over even and odd granules, each saved as a table, read and added up."""
    paths = []
    for odd in (0, 1):
        paths.append(store.workspace(spark, "statistics"))
        some = _scenes(spark, sf).where(F.col("granule") % 2 == odd)
        presets.save(presets.preset(some, "retrieval", centre=CENTRE), paths[-1])
    return rounded(presets.load(spark, *paths), 1e-9)


MONTHLY = ["month(scan_time)::INT", ubin("latitude", -90.0, 90.0, 72), ubin("longitude", -180.0, 180.0, 144)]


@query("a03_combined_bundle", answer(SCENE_SQL, [part("global", MONTHLY, "r", "'surface_precip'", total="sum(surface_precip)", where="surface_precip >= 0"), part("global_histogram", [*MONTHLY, RATE], "r", "'surface_precip'")]))
def a03_combined(spark, sf):
    """Monthly maps of rates in cells of 2.5 degrees."""
    return rounded(presets.preset(_scenes(spark, sf), "combined", monthly=True, resolution=2.5), 1e-9)


SPECIAL = f"surface_type IN ({', '.join(map(str, presets.SINGLE_ANGLE))})"
BIN_SQL = f"""{TB_SQL}, s AS (SELECT vec_id, (1 + surface_type)::INT AS surface_type, (vec_id % 5 - 1)::INT AS airmass_type, (1 + vec_id % 4)::INT AS pixel_position,
    (2395 + (vec_id * 31) % 1000)::DOUBLE / 10 AS t2m, ((vec_id * 17) % 1000)::DOUBLE / 10 - 0.5::DOUBLE AS tcwv, [tb[1:5], tb[6:10], tb[11:15]] AS tb,
    [abs(profile[1]) * 100, CASE WHEN vec_id % 7 = 0 THEN -9999.9::DOUBLE ELSE abs(profile[2]) * 100 END, abs(profile[3]) * 100] AS surface_precip, list_transform(profile, lambda x: x * 100) AS latent_heat FROM tb),
r AS (SELECT * EXCLUDE (tb, surface_precip), CASE WHEN {SPECIAL} THEN tb[1:1] ELSE tb END AS tb, CASE WHEN {SPECIAL} THEN surface_precip[1:1] ELSE surface_precip END AS surface_precip FROM s),
g AS (SELECT surface_type, pixel_position, unnest(tb) AS row, unnest(surface_precip) AS v, unnest(range(3))::INT AS i FROM r),
p AS (SELECT surface_type, row, v, CASE WHEN {SPECIAL} THEN CASE WHEN pixel_position <= 3 THEN pixel_position - 1 END ELSE i END AS angle FROM g WHERE row IS NOT NULL),
c AS (SELECT surface_type, angle, unnest(row) AS x, unnest(range(5))::INT AS channel FROM p),
v AS ({values({'surface_precip': True, 'latent_heat': True}, 'r', False, 'surface_type, t2m, tcwv')})"""
BIN_PARTS = [
    part("tb", ["surface_type", "channel", "angle", ubin("x", 0.0, 400.0, 400)], "c"),
    part("histogram", ["surface_type", "angle", ubin("v", 0.0, 500.0, 200)], "p", "'surface_precip'"),
    part("histogram", ["surface_type", "0", ubin("v", -500.0, 500.0, 200)], "(SELECT surface_type, unnest(vals) AS v FROM v WHERE target = 'latent_heat')", "'latent_heat'"),
    means("by_t2m", ["surface_type", T2M]),
    means("by_tcwv", ["surface_type", TCWV]),
    *ANCILLARY[:3],
    part("airmass", ["airmass_type"], "r", where="airmass_type >= 0"),
]


@query("a16_bin_bundle", answer(BIN_SQL, BIN_PARTS))
def a16_bins(spark, sf):
    """A-priori samples of a sensor with three viewing angles: arrays by angle, or one angle a record over some surfaces."""
    profile = lambda i: F.get("profile", F.lit(i))
    rates = F.array(F.abs(profile(0)) * 100, F.when(F.col("vec_id") % 7 == 0, -9999.9).otherwise(F.abs(profile(1)) * 100), F.abs(profile(2)) * 100)
    rows = F.array(*(F.slice("tb", k, 5) for k in (1, 6, 11)))
    first = F.col("surface_type").isin(presets.SINGLE_ANGLE)
    df = tb(spark, sf).withColumn("surface_type", (F.col("surface_type") + 1).cast("int")).select(
        "surface_type", (F.col("vec_id") % 5 - 1).cast("int").alias("airmass_type"), (1 + F.col("vec_id") % 4).cast("int").alias("pixel_position"),
        ((2395 + (F.col("vec_id") * 31) % 1000).cast("double") / 10).alias("t2m"), (((F.col("vec_id") * 17) % 1000).cast("double") / 10 - 0.5).alias("tcwv"),
        F.when(first, F.slice(rows, 1, 1)).otherwise(rows).alias("tb"), F.when(first, F.slice(rates, 1, 1)).otherwise(rates).alias("surface_precip"), F.transform("profile", lambda x: x * 100).alias("latent_heat"),
    )
    return rounded(presets.preset(df.withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0)}), "bin", angles=ANGLES), 1e-9)
