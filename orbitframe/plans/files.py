"""Queries of files and tables in a store: written in a format, read back with what is asked for pushed down; bins by partition, granules by time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from orbitframe.functions.clean import signed_round
from orbitframe.functions.physics import t2m_index
from orbitframe.operators import extraction, intervals
from orbitframe.plans.formats import F4, PIXELS, _pixels, f4
from orbitframe.plans.registry import query
from orbitframe.sources import bins, clusters, collocations, records, store, swathfiles, texttables
from orbitframe.sources.fixtures import OBS_SQL, TB_SQL, obs, tb


def _pixel_rows(back):
    return back.select(
        "granule", "scan", "pixel", f4("latitude").alias("latitude"), f4("two_meter_temperature").alias("t2m"), F.col("surface_type").cast("int").alias("surface_type"),
        F.col("airmass_type").cast("int").alias("airmass_type"), F.get("scan_date", F.lit(0)).cast("int").alias("year"),
    )


@query("s04_preprocessor_source", PIXELS)
def s04(spark, sf):
    """Files of the preprocessor format, read in ranges of 20000 bytes."""
    path = store.workspace(spark, "pp")
    swathfiles.write_granules(_pixels(spark, sf), "preprocessor", path)
    return _pixel_rows(swathfiles.read(spark, "preprocessor", path, maxPartitionBytes="20000"))


@query("s05_scans_from_the_end", PIXELS.removesuffix("FROM obs") + ", (max(scan) OVER (PARTITION BY granule))::INT AS last FROM obs QUALIFY obs.scan > last - 3")
def s05(spark, sf):
    """The last three scans of each file and its last scan number; a task seeks to them."""
    path = store.workspace(spark, "pp")
    swathfiles.write_granules(_pixels(spark, sf), "preprocessor", path)
    last = swathfiles.read(spark, "preprocessor", path, ["granule", "scan"], scans="-1").groupBy("granule").agg(F.max("scan").alias("last"))
    back = swathfiles.read(spark, "preprocessor", path, scans="-3:")
    return _pixel_rows(back).join(last, "granule")


@query("s05_pushed_scans", f"{PIXELS} WHERE granule >= 1 AND scan BETWEEN 10 AND 12 AND pixel < 20")
def s05p(spark, sf):
    """Bounds on granule and scan are applied by the source, that on the pixel by Spark."""
    path = store.workspace(spark, "pp")
    swathfiles.write_granules(_pixels(spark, sf), "preprocessor", path)
    return _pixel_rows(swathfiles.read(spark, "preprocessor", path).where("granule >= 1 and scan between 10 and 12 and pixel < 20"))


@query("k05_scan_limited_files", f"WITH {OBS_SQL} SELECT granule::INT AS granule, scan::INT AS scan, pixel::INT AS pixel, {F4.format('t2m')} AS t2m FROM obs WHERE scan < 10")
def k05(spark, sf):
    """The first ten scans of each file copied to new, gzipped files."""
    path, copy = store.workspace(spark, "pp"), store.workspace(spark, "copy")
    swathfiles.write_granules(_pixels(spark, sf), "preprocessor", path)
    swathfiles.write_granules(swathfiles.read(spark, "preprocessor", path, scans=":10"), "preprocessor", copy, compression="gzip")
    return swathfiles.read(spark, "preprocessor", copy).select("granule", "scan", "pixel", f4("two_meter_temperature").alias("t2m"))


LAYER = "round((scan + pixel * 0.5::DOUBLE + {k})::DOUBLE, 4)"


@query("s06_retrieval_profiles", f"""WITH {OBS_SQL} SELECT granule::INT AS granule, scan::INT AS scan, pixel::INT AS pixel, {F4.format('surface_precip')} AS surface_precip,
    {LAYER.format(k=0)} AS rain_1, {LAYER.format(k=27)} AS rain_28, {LAYER.format(k=111)} AS heat_28 FROM obs WHERE scan % 5 = 0 AND scan < 30""")
def s06(spark, sf):
    """Result files with four profiles of 28 layers a pixel, of some scans."""
    path = store.workspace(spark, "profiles")
    profiles = F.transform(F.sequence(F.lit(0), F.lit(111)), lambda k: (F.col("scan") + F.col("pixel") * 0.5 + k).cast("float"))
    df = _pixels(spark, sf).select("granule", "scan", "pixel", "latitude", F.nullif("surface_precip", F.lit(-9999.9).cast("float")).alias("surface_precip"), F.col("scan_date7").alias("scan_date"), profiles.alias("profiles"))
    options = {"variant": "profiles", "clusters": "1"}
    swathfiles.write_granules(df, "retrieval", path, **options)
    back = swathfiles.read(spark, "retrieval", path, ["granule", "scan", "pixel", "surface_precip", "profiles"], **options).where("scan in (0, 5, 10, 15, 20, 25)")
    layer = {"rain_1": 0, "rain_28": 27, "heat_28": 111}
    return records.null_missing(back, ["surface_precip"]).select("granule", "scan", "pixel", f4("surface_precip").alias("surface_precip"), *(F.round(F.get("profiles", F.lit(k)).cast("double"), 4).alias(c) for c, k in layer.items()))


@query("s08_match_files", f"WITH {OBS_SQL} SELECT granule::VARCHAR AS file_granule, {F4.format('latitude')} AS latitude, surface_type::INT AS surface_type, {F4.format('t2m')} AS tb3, (1 + sample_id % 28)::INT AS day FROM obs WHERE 1 + sample_id % 28 = 7")
def s08(spark, sf):
    """Gzipped match-ups, one file a granule, of one day of the month."""
    path, zero = store.workspace(spark, "match"), F.lit(0.0).cast("float")
    df = obs(spark, sf).select(
        F.format_string("match_%06d.bin", "granule").alias("file"), F.col("latitude").cast("float").alias("latitude"), "surface_type",
        F.array(F.lit(2019), F.lit(1), (1 + F.col("sample_id") % 28).cast("int"), F.lit(0), F.lit(0)).alias("scan_time"), F.array(*[zero] * 2, F.col("t2m").cast("float"), *[zero] * 8).alias("brightness_temperatures"),
    )
    swathfiles.write_records(df, "matchup", path, ["latitude"], variant="snow", channels="11", compression="gzip")
    back = swathfiles.read(spark, "matchup", path, ["file", "latitude", "surface_type", "scan_time", "brightness_temperatures"], variant="snow", channels="11")
    number, day = F.regexp_extract("file", r"match_0*(\d+)\.bin", 1), F.get("scan_time", F.lit(2))
    return back.where(day == 7).select(number.alias("file_granule"), f4("latitude").alias("latitude"), "surface_type", F.round(F.get("brightness_temperatures", F.lit(2)).cast("double"), 4).alias("tb3"), day.alias("day"))


BINNED = "(227 + (vec_id * 7) % 81)::INT AS t2m_bin, ((vec_id * 13) % 77)::INT AS tcwv_bin"


def _binned(spark, sf):
    return tb(spark, sf).select("vec_id", F.col("surface_type").cast("int").alias("surface_type"), (227 + (F.col("vec_id") * 7) % 81).cast("int").alias("t2m_bin"), ((F.col("vec_id") * 13) % 77).cast("int").alias("tcwv_bin"), "tb", "profile")


@query("s03_bin_files", f"WITH {TB_SQL} SELECT vec_id::INT AS dataset_number, {BINNED}, surface_type::INT AS surface_bin, {F4.format('tb[2]')} AS tb2 FROM tb WHERE 227 + (vec_id * 7) % 81 BETWEEN 240 AND 260 AND (vec_id * 13) % 77 BETWEEN 10 AND 50")
def s03f(spark, sf):
    """Bin files, of which those whose name lies in the ranges are opened."""
    path = store.workspace(spark, "bins")
    df = _binned(spark, sf).select(F.format_string("gpm_%03d_%02d_%02d.bin", "t2m_bin", "tcwv_bin", "surface_type").alias("file"), F.col("vec_id").cast("int").alias("dataset_number"), F.transform("tb", lambda t: t.cast("float")).alias("brightness_temperatures"))
    swathfiles.write_records(df, "apriori", path, ["dataset_number"])
    back = swathfiles.read(spark, "apriori", path, ["t2m_bin", "tcwv_bin", "surface_bin", "dataset_number", "brightness_temperatures"])
    return back.where("t2m_bin between 240 and 260 and tcwv_bin between 10 and 50").select("dataset_number", "t2m_bin", "tcwv_bin", "surface_bin", F.round(F.get("brightness_temperatures", F.lit(1)).cast("double"), 4).alias("tb2"))


@query("s03_bin_table", f"WITH {TB_SQL} SELECT vec_id, {BINNED}, surface_type::INT AS surface_type, round(tb[1], 6) AS tb1 FROM tb WHERE 227 + (vec_id * 7) % 81 BETWEEN 245 AND 262 AND (vec_id * 13) % 77 BETWEEN 15 AND 42")
def s03t(spark, sf):
    """A table by bin: the folders beside the ranges are not read."""
    path = store.workspace(spark, "bins")
    bins.write(_binned(spark, sf), path)
    return bins.read(spark, path, (245, 262), (15, 42)).select("vec_id", "t2m_bin", "tcwv_bin", "surface_type", F.round(F.get("tb", F.lit(0)), 6).alias("tb1"))


@query("s03_bins_of_a_list", f"WITH {TB_SQL}, b AS (SELECT vec_id, surface_type::INT AS surface_type, {BINNED} FROM tb) SELECT * FROM b WHERE (t2m_bin, tcwv_bin) IN (SELECT (t2m_bin, tcwv_bin) FROM b WHERE surface_type = 3 AND tcwv_bin < 20)")
def s03l(spark, sf):
    """All samples of the bins in which one surface class occurs; folders are pruned by the list when the query runs."""
    path = store.workspace(spark, "bins")
    bins.write(_binned(spark, sf), path)
    wanted = spark.read.parquet(path).where("surface_type = 3 and tcwv_bin < 20")
    return bins.read_listed(spark, path, wanted).select("vec_id", "t2m_bin", "tcwv_bin", "surface_type")


CATALOGUE_SQL = """g AS (SELECT event_id // 100 AS granule, event_id // 100 % 3 AS sensor, min(ts) AS t0 FROM events GROUP BY ALL),
cat AS (SELECT *, t0 + INTERVAL (40 + granule % 7 * 25) MINUTE AS t1, format('1C.{:06d}.V7', granule) AS file FROM g WHERE granule % 11 > 0)"""


@query("s10_granule_by_time", f"WITH {CATALOGUE_SQL}, p AS (SELECT event_id, event_id % 3 AS sensor, ts + INTERVAL 61 MINUTE AS at FROM events) SELECT event_id, count(file) AS n, min(file) AS file FROM p LEFT JOIN cat ON p.sensor = cat.sensor AND p.at BETWEEN t0 AND t1 GROUP BY event_id")
def s10(spark, sf):
    """The granule that a sensor had at each time, with gaps between granules and granules that overlap."""
    points, catalogue = _times(spark, sf)
    return intervals.first_at(points, catalogue, ["sensor"], "event_id", "at", "t0", "t1", "file", 3600)


def _times(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    granule = F.expr("event_id div 100")
    found = events.groupBy(granule.alias("granule"), (granule % 3).alias("sensor")).agg(F.min("ts").alias("t0")).where("granule % 11 > 0")
    length = F.make_dt_interval(mins=(40 + F.col("granule") % 7 * 25).cast("int"))
    catalogue = found.select("granule", "sensor", "t0", (F.col("t0") + length).alias("t1"), F.format_string("1C.%06d.V7", "granule").alias("file"))
    points = events.select("event_id", (F.col("event_id") % 3).alias("sensor"), (F.col("ts") + F.expr("interval 61 minutes")).alias("at"))
    return points, catalogue


@query("s10_file_of_granule", f"WITH {CATALOGUE_SQL} SELECT granule, file FROM cat")
def s10n(spark, sf):
    """The one file of each granule number."""
    return intervals.by_number(_times(spark, sf)[1], "granule", "file")


@query("d04_extraction", f"""WITH {OBS_SQL} SELECT granule::INT AS granule, granule % 4 = 3 AS failed, CASE WHEN granule % 4 <> 3 THEN count(*) END AS n,
    CASE WHEN granule % 4 <> 3 THEN round(sum(surface_type), 6) END AS surfaces FROM obs WHERE granule % 4 = 3 OR tcwv >= 20 GROUP BY granule""")
def d04(spark, sf):
    """Files of granules, of which every fourth promises more scans than it holds, through a filter; what failed is a row as well."""
    source, out = store.workspace(spark, "pp"), store.workspace(spark, "extracted")
    pixels = _pixels(spark, sf)
    swathfiles.write_granules(pixels.where("granule % 4 <> 3"), "preprocessor", source)
    swathfiles.write_granules(pixels.where("granule % 4 = 3"), "preprocessor", source, **{"header.number_of_scans": "1000"})
    kept = lambda df: df.where("round(total_column_water_vapor, 2) >= 20").select("path", "granule", "surface_type")
    said = extraction.extract(spark, source, "preprocessor", out, kept, ["granule", "total_column_water_vapor", "surface_type"])
    found = extraction.results(spark, out).groupBy("granule").agg(F.count("*").alias("n"), F.sum("surface_type").cast("double").alias("surfaces"))
    number = F.regexp_extract("path", r"0*(\d+)\.pp$", 1).cast("int")
    return said.select(number.alias("granule"), F.col("error").isNotNull().alias("failed")).join(found, "granule", "left")


CLUSTER_SQL = """rc AS (SELECT (vec_id % 12)::INT AS t, (vec_id % 5)::INT AS s, (vec_id // 12 % 40)::INT + 1 AS code, avg(profile[1]) AS first, avg(profile[28]) AS last FROM tb GROUP BY ALL
    UNION ALL SELECT (vec_id % 12)::INT, 1, (vec_id // 12 % 40)::INT + 41, avg(abs(profile[1])), avg(abs(profile[28])) FROM tb GROUP BY ALL),
c AS (SELECT t, s, code, first::FLOAT::DOUBLE AS first, last::FLOAT::DOUBLE AS last FROM rc)"""


@query("s20_profiles_of_clusters", f"""WITH {OBS_SQL}, {TB_SQL}, {CLUSTER_SQL}, x AS (SELECT granule::INT AS granule, scan::INT AS scan, pixel::INT AS pixel, (greatest(least(round_even((t2m - 268) / 3, 0), 12), 1) - 1)::INT AS t,
    list_transform(range(5), lambda s: (sample_id * (s + 1) % 90 - 4)::INT) AS codes, list_transform(range(5), lambda s: 1 + s * 0.5::DOUBLE + sample_id % 4) AS scales FROM obs)
    SELECT granule, scan, pixel, round(r.first * scales[1], 4) AS rain_1, round(r.last * scales[1], 4) AS rain_28, round(l.first * scales[2], 4) AS cloud_1, round(w.last * scales[3], 4) AS snow_28, round(h.first * scales[5], 4) AS heat_1
    FROM x LEFT JOIN c r ON r.s = 0 AND r.t = x.t AND r.code = codes[1] LEFT JOIN c l ON l.s = 1 AND l.t = x.t AND l.code = codes[2] LEFT JOIN c w ON w.s = 2 AND w.t = x.t AND w.code = codes[3] LEFT JOIN c h ON h.s = 4 AND h.t = x.t AND h.code = codes[5]""")
def s20p(spark, sf):
    """Cluster files and result files that name clusters, read and put together to profiles."""
    rows = tb(spark, sf).withColumns({"t_idx": (F.col("vec_id") % 12).cast("int"), "species": (F.col("vec_id") % 5).cast("int"), "cluster": F.expr("cast(vec_id div 12 % 40 as int)")})
    mean = lambda of: F.array(*(F.avg(of(F.get("profile", F.lit(k)))) for k in range(28)))
    rain = rows.groupBy("t_idx", "species", "cluster").agg(mean(lambda v: v).alias("profile")).withColumn("raining", F.lit(True))
    rest = rows.groupBy("t_idx", "cluster").agg(mean(F.abs).alias("profile")).withColumns({"raining": F.lit(False), "species": F.lit(0)})
    tables, results = store.workspace(spark, "clusters"), store.workspace(spark, "results")
    clusters.write(rain.unionByName(rest), tables)
    codes = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda s: (F.col("sample_id") * (s + 1) % 90 - 4).cast("smallint"))
    scales = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda s: (1 + s * 0.5 + F.col("sample_id") % 4).cast("float"))
    pixels = obs(spark, sf).select(*(F.col(k).cast("int").alias(k) for k in ("granule", "scan", "pixel")), (t2m_index(F.col("t2m")) + 1).cast("smallint").alias("profile_t2m_index"), codes.alias("profile_index"), scales.alias("profile_scale"), F.array(*(F.lit(v).cast("smallint") for v in (2019, 1, 1, 0, 0, 0, 0))).alias("scan_date"))
    swathfiles.write_granules(pixels, "retrieval", results, clusters="1")
    back = swathfiles.read(spark, "retrieval", results, ["granule", "scan", "pixel", "profile_t2m_index", "profile_index", "profile_scale"], clusters="1")
    out = clusters.decode(back, clusters.read(spark, tables))
    layer = {"rain_1": ("rain_water_content", 0), "rain_28": ("rain_water_content", 27), "cloud_1": ("cloud_water_content", 0), "snow_28": ("snow_water_content", 27), "heat_1": ("latent_heat", 0)}
    return out.select("granule", "scan", "pixel", *(signed_round(F.get(c, F.lit(k)), 4).alias(name) for name, (c, k) in layer.items()))


PLACES_SQL = "w AS (SELECT *, CASE WHEN sample_id % 13 > 0 THEN surface_precip + 0.5 END AS second, CASE WHEN sample_id % 5 = 0 THEN -9999.9 ELSE tcwv / 10 END AS third FROM obs)"


def _places(spark, sf):
    second, third = F.when(F.col("sample_id") % 13 > 0, F.col("surface_precip") + 0.5), F.when(F.col("sample_id") % 5 == 0, -9999.9).otherwise(F.col("tcwv") / 10)
    rates = {"surface_precip_one": F.col("surface_precip"), "surface_precip_two": second, "surface_precip_three": third, "pop_two": F.col("rqi") * 100}
    return obs(spark, sf).withColumns(rates).select("granule", "sample_id", "scan_time", "surface_type", "mask", "rqi", "surface_precip_ref", *rates)


@query("s24_stored_collocations", f"""WITH {OBS_SQL}, {PLACES_SQL}, k AS (SELECT * FROM w WHERE surface_precip_ref >= 0 AND rqi >= 0.2 AND surface_precip >= 0 AND second >= 0 AND third >= 0)
    SELECT grp, sample_id, round(v, 6) AS surface_precip, round(pop, 6) AS pop, surface_precip_ref FROM (SELECT 'one' AS grp, sample_id, surface_precip AS v, NULL::DOUBLE AS pop, surface_precip_ref FROM k
    UNION ALL SELECT 'two', sample_id, second, rqi * 100, surface_precip_ref FROM k UNION ALL SELECT 'three', sample_id, third, NULL, surface_precip_ref FROM k)""")
def s24s(spark, sf):
    """Collocations written by month and read as samples of three groups, at places where all of them have a rate."""
    path = store.workspace(spark, "collocations")
    collocations.write(_places(spark, sf), path)
    out = collocations.samples(collocations.read(spark, path), ["one", "two", "three"], rqi=0.2)
    return out.select("grp", "sample_id", F.round("surface_precip", 6).alias("surface_precip"), F.round("pop", 6).alias("pop"), "surface_precip_ref")


@query("s24_samples_of_days", f"""WITH {OBS_SQL}, {PLACES_SQL}, k AS (SELECT * FROM w WHERE surface_precip_ref >= 0 AND scan_time >= DATE '2024-01-10' AND scan_time < DATE '2024-01-25')
    SELECT grp, sample_id, round(v, 6) AS surface_precip FROM (SELECT 'one' AS grp, sample_id, surface_precip AS v FROM k UNION ALL SELECT 'two', sample_id, second FROM k) WHERE v >= 0""")
def s24d(spark, sf):
    """The samples of a range of days, each group where it has a rate itself; other months are not read."""
    path = store.workspace(spark, "collocations")
    collocations.write(_places(spark, sf), path)
    out = collocations.samples(collocations.read(spark, path, date(2024, 1, 10), date(2024, 1, 25)), ["one", "two"], common=False)
    return out.select("grp", "sample_id", F.round("surface_precip", 6).alias("surface_precip"))


@query("k11_sensitivity_file", f"WITH {TB_SQL}, l AS (SELECT surface_type, unnest(tb) AS v, unnest(range(15))::INT AS channel FROM tb) SELECT surface_type::INT AS surface_type, channel, round(avg(v) + 1e-7, 2) AS sensitivity FROM l GROUP BY ALL")
def k11s(spark, sf):
    """A table of channels by surface as text, written and read."""
    path = store.workspace(spark, "sensitivities")
    mean = tb(spark, sf).groupBy("surface_type").agg(F.array(*(F.avg(F.get("tb", F.lit(k))) + 1e-7 for k in range(15))).alias("tb"))
    texttables.write(mean, path, "surface_type", "tb", 15, "surface\nchannels")
    return texttables.read(spark, path, "surface_type", "sensitivity").select("surface_type", F.posexplode("sensitivity").alias("channel", "sensitivity"))
