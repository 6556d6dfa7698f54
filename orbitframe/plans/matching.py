"""Queries of the matches of several sources, of geometry and of surface classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitframe.functions import geometry as gm
from orbitframe.functions import surface
from orbitframe.functions.geo import ecef
from orbitframe.operators import collocate as co
from orbitframe.plans.collocation import AT, AT2, PAIRS, _left
from orbitframe.plans.registry import query
from orbitframe.plans.scalars import HAV
from orbitframe.plans.verification import rounded
from orbitframe.sources.fixtures import OBS_SQL, SWATH_SQL, obs, other_swath, swath


def _nearest(left, right, key, value, at, at2, km):
    return co.nearest(left, right, ["granule"], key, value, value, at, at2, km)


@query("j03_snow_corrected_match", f"WITH {SWATH_SQL}, {PAIRS}, g AS (SELECT granule, min(scan_time) AS t0, max(scan_time) AS t1 FROM swath GROUP BY granule), m AS (SELECT o.sample_id, CASE WHEN o.sample_id % 4 <> 1 THEN o.surface_precip - 0.3 * o.surface_precip + 0.3 * o.surface_precip * (1 + (o.sample_id % 4) / 10.0::DOUBLE) END AS v FROM other o JOIN g USING (granule) WHERE scan_time >= t0 AND scan_time < t1), n AS (SELECT sample_id, arg_min(left_id, distance) AS left_id FROM pairs WHERE distance <= 15 GROUP BY sample_id) SELECT left_id, round(arg_max(v, sample_id) + 1e-9, 6) AS surface_precip FROM n JOIN m USING (sample_id) WHERE v IS NOT NULL GROUP BY left_id")
def j03(spark, sf):
    """Match-ups inside the granule's time, with the snow rate corrected by a ratio; no rate where there is no ratio."""
    span = swath(spark, sf).groupBy("granule").agg(F.min("scan_time").alias("t0"), F.max("scan_time").alias("t1"))
    other = other_swath(spark, sf).join(span, "granule").where("scan_time >= t0 and scan_time < t1")
    snow, ratio = 0.3 * F.col("surface_precip"), 1 + F.col("sample_id") % 4 / 10
    other = other.withColumn("v", F.when(F.col("sample_id") % 4 != 1, F.col("surface_precip") - snow + snow * ratio))
    hit = _nearest(other, _left(spark, sf), "sample_id", "left_id", AT2, AT, 15.0).join(other.select("sample_id", "v").where("v is not null"), "sample_id")
    return rounded(hit.groupBy("left_id").agg(F.max_by("v", "sample_id").alias("surface_precip")), 1e-9)


@query("j04_fine_match", f"WITH {SWATH_SQL}, l AS (SELECT *, lead(lat) OVER (PARTITION BY granule, pixel ORDER BY scan) AS after FROM swath), h AS MATERIALIZED (SELECT granule, scan * 3 + k.range AS scan3, pixel, lat + (coalesce(after, lat) - lat) * k.range / 3 AS lat, lon FROM l, range(3) k WHERE k.range = 0 OR after IS NOT NULL), p AS (SELECT s.granule, s.scan3, s.pixel, o.sample_id, {HAV.format(a='s.lat', b='o.lat2', c='s.lon', d='o.lon2')} AS distance FROM (SELECT *, unnest([-1, 0, 1]) + floor(lat * 10)::INT AS band FROM h) s JOIN (SELECT *, floor(lat2 * 10)::INT AS band FROM other) o ON o.granule = s.granule AND o.band = s.band AND abs(s.lat - o.lat2) < 0.1 AND abs(s.lon - o.lon2) < 0.3), n AS (SELECT granule, scan3, pixel, arg_min(sample_id, distance) AS sample_id FROM p WHERE distance <= 4 GROUP BY ALL) SELECT h.granule, h.scan3, h.pixel, n.sample_id FROM h LEFT JOIN n USING (granule, scan3, pixel)")
def j04(spark, sf):
    """Nearest record of a fine product within 4 km of the places of the swath that is three times as dense along the track."""
    after = F.lead("lat").over(Window.partitionBy("granule", "pixel").orderBy("scan"))
    fine = swath(spark, sf).withColumn("after", after).withColumn("k", F.explode(F.expr("sequence(0, if(after is null, 0, 2))")))
    fine = fine.select("granule", (F.col("scan") * 3 + F.col("k")).alias("scan3"), "pixel", (F.col("lat") + (F.coalesce("after", "lat") - F.col("lat")) * F.col("k") / 3).alias("lat"), "lon")
    fine = fine.withColumn("place", F.col("scan3") * 25 + F.col("pixel") + F.col("granule") * 3000)
    found = _nearest(fine, other_swath(spark, sf), "place", "sample_id", AT, AT2, 4.0).select("place", "sample_id")
    return fine.join(found, "place", "left").select("granule", "scan3", "pixel", "sample_id")


@query("j05_edges_and_fill", f"WITH {SWATH_SQL}, {PAIRS}, n AS (SELECT left_id, arg_min(sample_id, distance) AS sample_id FROM pairs WHERE distance <= 9 GROUP BY left_id) SELECT s.sample_id AS left_id, coalesce(CASE WHEN o.pixel NOT IN (0, 24) THEN o.surface_type END, -999)::INT AS surface_type, CASE WHEN o.pixel NOT IN (0, 24) THEN o.tcwv END AS tcwv FROM swath s LEFT JOIN n ON n.left_id = s.sample_id LEFT JOIN other o ON o.sample_id = n.sample_id")
def j05e(spark, sf):
    """Without a neighbour, or with one on the edge of its swath, numbers are missing: null, and -999 in integers."""
    found = _nearest(_left(spark, sf), other_swath(spark, sf), "left_id", "sample_id", AT, AT2, 9.0).select("left_id", "sample_id")
    inner = other_swath(spark, sf).where("pixel not in (0, 24)").select("sample_id", "surface_type", "tcwv")
    out = _left(spark, sf).select("left_id").join(found, "left_id", "left").join(inner, "sample_id", "left")
    return out.select("left_id", F.coalesce("surface_type", F.lit(-999)).alias("surface_type"), "tcwv")


@query("j06_simulator_on_grid", f"WITH {SWATH_SQL}, {PAIRS}, n AS (SELECT sample_id, arg_min(left_id, distance) AS left_id, any_value(surface_precip) AS v FROM pairs WHERE distance <= 5 GROUP BY sample_id) SELECT left_id, arg_max(v, sample_id) AS surface_precip FROM n WHERE v IS NOT NULL GROUP BY left_id")
def j06(spark, sf):
    one = _nearest(other_swath(spark, sf), _left(spark, sf), "sample_id", "left_id", AT2, AT, 5.0)
    hit = one.join(obs(spark, sf).where("surface_precip is not null").select("sample_id", "surface_precip"), "sample_id")
    return hit.groupBy("left_id").agg(F.max_by("surface_precip", "sample_id").alias("surface_precip"))


@query("j07_angles_on_grid", f"WITH {SWATH_SQL}, {PAIRS}, n AS (SELECT left_id, arg_min(sample_id, distance) AS sample_id FROM pairs WHERE distance <= 20 GROUP BY left_id) SELECT left_id, round(52.8 + (sample_id % 25) * 0.01::DOUBLE, 6) AS angle FROM n")
def j07(spark, sf):
    found = _nearest(_left(spark, sf), other_swath(spark, sf), "left_id", "sample_id", AT, AT2, 20.0)
    return rounded(found.select("left_id", (52.8 + (F.col("sample_id") % 25) * 0.01).alias("angle")))


ERA = "((i * 7 + j * 3 + h) % 50)::DOUBLE / 1000"


@query("j09_reanalysis_lookup", f"WITH {OBS_SQL}, r AS (SELECT range // 864 AS i, range // 24 % 36 AS j, range % 24 AS h FROM range(16416)), q AS (SELECT sample_id, round((latitude + 90) / 10)::BIGINT AS i, (round((CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END) / 10)::BIGINT) % 36 AS j, (round((hour(scan_time) * 60 + minute(scan_time)) / 60.0::DOUBLE)::BIGINT) % 24 AS h FROM obs WHERE surface_type IN (2, 16)) SELECT sample_id, round({ERA} * 1000, 6) AS precip FROM q JOIN r USING (i, j, h)")
def j09(spark, sf):
    """Reanalysis rates at the nearest grid point and hour, in mm/h, for pixels over sea ice; longitudes go round."""
    r = spark.range(16416).select(F.expr("id div 864").alias("i"), F.expr("id div 24 % 36").alias("j"), F.expr("id % 24").alias("h"))
    r = r.withColumn("rate", ((F.col("i") * 7 + F.col("j") * 3 + F.col("h")) % 50).cast("double") / 1000)
    lon = F.when(F.col("longitude") < 0, F.col("longitude") + 360).otherwise(F.col("longitude"))
    hour = F.round((F.hour("scan_time") * 60 + F.minute("scan_time")) / F.lit(60.0)).cast("long") % 24
    q = obs(spark, sf).where("surface_type in (2, 16)").select("sample_id", F.round((F.col("latitude") + 90) / 10).cast("long").alias("i"), (F.round(lon / 10).cast("long") % 36).alias("j"), hour.alias("h"))
    return q.join(r, ["i", "j", "h"]).select("sample_id", F.round(F.col("rate") * 1000, 6).alias("precip"))


@query("j13_shifted_rasters", f"WITH {OBS_SQL} SELECT sample_id, ((floor(latitude + 90)::BIGINT * 5 + (floor(longitude + 180)::BIGINT % 360) * 11) % 17)::INT AS surface, ((floor(latitude + 90.5)::BIGINT * 3 + (floor(longitude + 180.5)::BIGINT % 360)) % 4)::INT AS mountain FROM obs")
def j13(spark, sf):
    """Two rasters, the second of which is shifted by half a cell."""
    cells = spark.range(181 * 360).select(F.expr("cast(id div 360 as int)").alias("lat_idx"), F.expr("cast(id % 360 as int)").alias("lon_idx"))
    one = cells.withColumn("surface", ((F.col("lat_idx") * 5 + F.col("lon_idx") * 11) % 17).cast("int"))
    two = cells.withColumn("mountain", ((F.col("lat_idx") * 3 + F.col("lon_idx")) % 4).cast("int"))
    df = co.lookup(obs(spark, sf).select("sample_id", "latitude", "longitude"), one, "latitude", "longitude", 1.0).drop("lat_idx", "lon_idx")
    return co.lookup(df, two, "latitude", "longitude", 1.0, shift=0.5).select("sample_id", "surface", "mountain")


@query("g06_bilinear_lookup", f"WITH {OBS_SQL}, q AS (SELECT sample_id, latitude + 90 AS y, longitude + 180 AS x, floor(latitude + 90)::BIGINT AS i, floor(longitude + 180)::BIGINT AS j FROM obs), c AS (SELECT sample_id, (1 - abs(y - (i + a.range))) * (1 - abs(x - (j + b.range))) AS w, (((i + a.range) * 7 + ((j + b.range) % 360) * 3) % 50)::DOUBLE AS v FROM q, range(2) a, range(2) b) SELECT sample_id, round(sum(w * v) / sum(w), 6) AS ratio FROM c GROUP BY sample_id")
def g06(spark, sf):
    cells = spark.range(181 * 360).select(F.expr("cast(id div 360 as int)").alias("lat_idx"), F.expr("cast(id % 360 as int)").alias("lon_idx"))
    raster = cells.withColumn("v", ((F.col("lat_idx") * 7 + F.col("lon_idx") * 3) % 50).cast("double"))
    return rounded(co.bilinear(obs(spark, sf), raster, "sample_id", "latitude", "longitude", "v", 1.0).select("sample_id", F.col("v").alias("ratio")))


@query("j15_pasted_predictions", f"WITH {OBS_SQL}, p AS (SELECT sample_id, tcwv / 10 AS predicted FROM obs WHERE sample_id % 2 = 0) SELECT o.sample_id, CASE WHEN o.airmass_type = 0 THEN round(p.predicted, 6) ELSE round(o.surface_precip, 6) END AS surface_precip FROM obs o LEFT JOIN p USING (sample_id)")
def j15(spark, sf):
    """Predictions replace the values of the rows of one source; rows of it without a prediction are missing."""
    p = obs(spark, sf).where("sample_id % 2 = 0").select("sample_id", (F.col("tcwv") / 10).alias("predicted"))
    return rounded(obs(spark, sf).join(p, "sample_id", "left").select("sample_id", F.when(F.col("airmass_type") == 0, F.col("predicted")).otherwise(F.col("surface_precip")).alias("surface_precip")))


@query("j16_row_times", f"WITH {OBS_SQL}, t AS (SELECT granule, scan, epoch_us(min(scan_time)) AS t FROM obs GROUP BY ALL), l AS (SELECT *, lead(t) OVER (PARTITION BY granule ORDER BY scan) AS after FROM t), r AS (SELECT range::INT AS along, range * 37 // 100 AS scan, (range * 37 % 100) / 100.0::DOUBLE AS part FROM range(105)) SELECT granule, along, round(t + part * (after - t))::BIGINT AS t FROM r JOIN l USING (scan) WHERE after IS NOT NULL")
def j16(spark, sf):
    """Times of the rows of a finer grid, linear between scans."""
    t = obs(spark, sf).groupBy("granule", "scan").agg(F.unix_micros(F.min("scan_time").cast("timestamp")).alias("t"))
    t = t.withColumn("after", F.lead("t").over(Window.partitionBy("granule").orderBy("scan"))).where("after is not null")
    rows = F.broadcast(spark.range(105).select(F.col("id").cast("int").alias("along"), F.expr("id * 37 div 100").alias("scan"), (F.expr("id * 37 % 100") / F.lit(100.0)).alias("part")))  # 105 rows
    return t.join(rows, "scan").select("granule", "along", F.round(F.col("t") + F.col("part") * (F.col("after") - F.col("t"))).cast("long").alias("t"))


AREA = "a AS (SELECT range AS cell, (range % 20 - 10) * 20000.0::DOUBLE AS x, (range // 20 - 10) * 20000.0::DOUBLE AS y FROM range(400)), c AS (SELECT *, sqrt(x * x + y * y) AS rho, 2 * asin(sqrt(x * x + y * y) / 12742000.0::DOUBLE) AS c FROM a), s AS (SELECT *, CASE WHEN rho = 0 THEN 0 ELSE sin(c) / rho END AS s FROM c), area AS (SELECT cell, x, y, degrees(asin(cos(c) * sin(radians(-47.5::DOUBLE)) + y * s * cos(radians(-47.5::DOUBLE)))) AS alat, -128 + degrees(atan2(x * s, cos(c) * cos(radians(-47.5::DOUBLE)) - y * s * sin(radians(-47.5::DOUBLE)))) AS alon FROM s)"


def _area(spark):
    a = spark.range(400).select(F.col("id").alias("cell"), ((F.col("id") % 20 - 10) * 20000.0).alias("x"), ((F.expr("id div 20") - 10) * 20000.0).alias("y"))
    lat, lon = gm.equal_area_inverse(F.col("x"), F.col("y"), -47.5, -128.0)
    return a.withColumns({"alat": lat, "alon": lon})


@query("j18_area_grid", f"WITH {AREA} SELECT cell, round(alat, 6) AS lat, round(alon, 6) AS lon FROM area")
def j18(spark, sf):
    return rounded(_area(spark).select("cell", F.col("alat").alias("lat"), F.col("alon").alias("lon")))


@query("j18_area_round_trip", "SELECT range AS cell, round((range % 20 - 10) * 20000.0::DOUBLE, 3) AS x, round((range // 20 - 10) * 20000.0::DOUBLE, 3) AS y FROM range(400)")
def j18r(spark, sf):
    x, y = gm.equal_area(F.col("alat"), F.col("alon"), -47.5, -128.0)
    return _area(spark).select("cell", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query("j18_profiles_on_area", f"""WITH {SWATH_SQL}, {AREA}, p AS (SELECT w.granule, r.cell, w.surface_precip AS a, w.tcwv AS b, w.surface_precip_ref AS c, {HAV.format(a='r.alat', b='w.lat', c='r.alon', d='w.lon')} AS d FROM swath w
    JOIN area r ON abs(r.alat - w.lat) < 0.3 AND abs(r.alon - w.lon) < 0.4), e AS (SELECT *, exp(0 - (d / 6.0::DOUBLE) ** 2) AS w FROM p WHERE d <= 10)
    SELECT granule, cell, count(*) AS n, round(sum(w * a) / sum(w) FILTER (WHERE a IS NOT NULL), 6) AS first, round(sum(w * b) / sum(w), 6) AS second, round(sum(w * c) / sum(w) FILTER (WHERE c IS NOT NULL), 6) AS third FROM e GROUP BY ALL""")
def j18p(spark, sf):
    """Profiles of each overpass on the places of a study area, as Gaussian means of what lies within 10 km."""
    right = swath(spark, sf).select("granule", *AT, F.array("surface_precip", "tcwv", "surface_precip_ref").alias("profile"))
    out = co.resample_profiles(right, _area(spark).select("cell", "alat", "alon"), [], ["granule", "cell"], "profile", 3, AT, ("alat", "alon"), 10.0, 6.0)
    return rounded(out.select("granule", "cell", "n", *(F.get("profile", F.lit(i)).alias(c) for i, c in enumerate(("first", "second", "third")))))


@query("j17_overpass_on_area", f"WITH {SWATH_SQL}, {AREA}, p AS (SELECT w.granule, r.cell, w.sample_id, {HAV.format(a='r.alat', b='w.lat', c='r.alon', d='w.lon')} AS d FROM swath w JOIN area r ON abs(r.alat - w.lat) < 0.3 AND abs(r.alon - w.lon) < 0.4) SELECT granule, cell, arg_min(sample_id, (round(d, 6), sample_id)) AS sample_id FROM p WHERE d <= 10 GROUP BY ALL")
def j17(spark, sf):
    """The nearest pixel of each overpass within 10 km of each place of a study area."""
    pairs = co.neighbours(swath(spark, sf).select("granule", "sample_id", *AT), _area(spark).select("cell", "alat", "alon"), [], AT, ("alat", "alon"), 10.0)
    return pairs.groupBy("granule", "cell").agg(F.min_by("sample_id", F.struct(F.round("distance", 6), "sample_id")).alias("sample_id"))


MHS = gm.CrossTrack(855_000.0, 98.9, 90, 17_500.0, 1.11)
RATIO = f"({MHS.ratio!r}::DOUBLE)"
BETA = "radians((pixel - 45) / 90.0::DOUBLE * 98.9)"
INC = f"degrees(asin(sin(radians(-98.9 / 2 + pixel * (98.9::DOUBLE / 89))) * {RATIO}))"


@query("f22_cross_track", f"WITH {OBS_SQL}, q AS (SELECT sample_id, scan, sample_id % 90 AS pixel FROM obs), a AS (SELECT *, {INC} AS inc, asin(sin(radians({INC})) / {RATIO}) AS view FROM q), b AS (SELECT *, greatest(-radians(49.45), least(radians(49.45), view)) AS beta FROM a) SELECT sample_id, round(scan * 17500.0::DOUBLE, 3) AS along, round(6371000 * (asin(sin({BETA}) * {RATIO}) - {BETA}), 3) AS across, round(inc, 6) AS incidence, round(6371000 * ({RATIO} * cos(beta) / sqrt(1 - ({RATIO} * sin(beta)) ** 2) - 1) * radians(1.11::DOUBLE), 3) AS resolution, round(pixel::DOUBLE, 6) AS pixel FROM b")
def f22(spark, sf):
    """Places, incidence and resolution across the scan, and the pixel again from its place."""
    q = obs(spark, sf).select("sample_id", "scan", (F.col("sample_id") % 90).alias("pixel"))
    along, across = MHS.place(F.col("scan"), F.col("pixel"))
    inc = MHS.incidence(F.col("pixel"))
    return q.select("sample_id", F.round(along, 3).alias("along"), (F.round(across, 3) + 0.0).alias("across"), F.round(inc, 6).alias("incidence"), F.round(MHS.resolution_across(inc), 3).alias("resolution"), (F.round(MHS.pixel(along, across)[1], 6) + 0.0).alias("pixel"))


def ecef_sql(lat: str, lon: str, alt: str = "0.0") -> str:
    e2 = "0.0066943799901413165::DOUBLE"
    n = f"(6378137::DOUBLE / sqrt(1 - {e2} * sin(radians({lat})) ** 2))"
    return f"[({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})), ({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})), ({n} * (1 - {e2}) + {alt}) * sin(radians({lat}))]"


def dot_sql(a: str, b: str) -> str:
    return f"({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"


@query("f23_footprint_rotation", f"WITH {SWATH_SQL}, p AS (SELECT sample_id, granule, scan, pixel, {ecef_sql('lat', 'lon')} AS pos, {ecef_sql('(lat - 4)', '(-128.2::DOUBLE)', '407000')} AS sc, [cos(radians(lat)) * cos(radians(lon)), cos(radians(lat)) * sin(radians(lon)), sin(radians(lat))] AS up FROM swath), l AS (SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS after FROM p WINDOW w AS (PARTITION BY granule, pixel ORDER BY scan)), d AS (SELECT *, list_transform([1, 2, 3], lambda i: pos[i] - before[i]) AS u0, list_transform([1, 2, 3], lambda i: after[i] - pos[i]) AS v0, list_transform([1, 2, 3], lambda i: pos[i] - sc[i]) AS view FROM l), n AS (SELECT *, CASE WHEN before IS NULL THEN NULL ELSE list_transform(u0, lambda x: x / sqrt({dot_sql('u0', 'u0')})) END AS u, CASE WHEN after IS NULL THEN NULL ELSE list_transform(v0, lambda x: x / sqrt({dot_sql('v0', 'v0')})) END AS v FROM d), a AS (SELECT *, CASE WHEN u IS NULL THEN v WHEN v IS NULL THEN u ELSE list_transform([1, 2, 3], lambda i: (u[i] + v[i]) / 2) END AS al FROM n), c AS (SELECT *, [up[2] * al[3] - up[3] * al[2], up[3] * al[1] - up[1] * al[3], up[1] * al[2] - up[2] * al[1]] AS ac FROM a) SELECT sample_id, round(degrees(atan2({dot_sql('view', 'ac')}, {dot_sql('view', 'al')})), 4) + 0.0 AS angle FROM c")
def f23(spark, sf):
    df = swath(spark, sf)
    at = ecef(F.col("lat"), F.col("lon"))
    craft = ecef(F.col("lat") - 4, F.lit(-128.2), F.lit(407_000.0))
    df = df.select("sample_id", "granule", "scan", "pixel", "lat", "lon", *(c.alias(f"a{k}") for k, c in enumerate(at)), *(c.alias(f"s{k}") for k, c in enumerate(craft)))
    w = Window.partitionBy("granule", "pixel").orderBy("scan")
    df = df.withColumns({f"b{k}": F.lag(f"a{k}").over(w) for k in range(3)} | {f"n{k}": F.lead(f"a{k}").over(w) for k in range(3)})
    vector = lambda p: tuple(F.col(f"{p}{k}") for k in range(3))
    angle = gm.rotation(vector("a"), vector("b"), vector("n"), gm.up(F.col("lat"), F.col("lon")), vector("s"))
    return df.select("sample_id", (F.round(angle, 4) + 0.0).alias("angle"))


@query("f24_radar_gates", f"WITH {OBS_SQL}, g AS (SELECT sample_id, radians((sample_id % 360)::DOUBLE) AS az, radians(0.5::DOUBLE) AS el, (sample_id % 150) * 1000.0::DOUBLE AS r, {ecef_sql('8.718::DOUBLE', '167.733::DOUBLE')} AS h FROM obs) SELECT sample_id, round(h[1] + r * cos(el) * (cos(az) * -sin(radians(8.718)) * cos(radians(167.733)) - sin(az) * sin(radians(167.733))) + r * sin(el) * cos(radians(8.718)) * cos(radians(167.733)), 2) AS x, round(h[3] + r * cos(el) * cos(az) * cos(radians(8.718)) + r * sin(el) * sin(radians(8.718)), 2) AS z FROM g")
def f24(spark, sf):
    x, _, z = gm.radar_place(8.718, 167.733, (F.col("sample_id") % 360).cast("double"), F.lit(0.5), (F.col("sample_id") % 150) * 1000.0)
    return obs(spark, sf).select("sample_id", F.round(x, 2).alias("x"), F.round(z, 2).alias("z"))


LATEST = "coalesce(list_filter(list_transform(range(12), lambda i: e[((m - i) % 12 + 12) % 12 + 1]), lambda x: x < 6 OR x = 10)[1], 9)"


@query("f19_surface_classes", f"""WITH {OBS_SQL}, q AS (SELECT sample_id, latitude, longitude, (sample_id * 13 % 103 - 2)::INT AS land, list_extract([0, 1, 2, 3, 5, 2, 1], (sample_id % 7)::INT + 1) AS snow, list_transform(range(12), lambda k: ((sample_id * (k + 3) + k) % 11)::INT) AS e, (sample_id % 12)::INT AS m, (sample_id % 3)::INT AS mtn FROM obs),
 s AS (SELECT *, CASE WHEN snow = 3 THEN 2 WHEN snow = 5 THEN 16 WHEN land < 0 THEN 0 WHEN land <= 2 THEN CASE WHEN snow = 2 THEN 2 ELSE 1 END WHEN land <= 95 THEN CASE WHEN snow = 2 THEN 10 WHEN land <= 25 THEN 13 WHEN land <= 75 THEN 14 ELSE 15 END
  WHEN snow = 2 THEN CASE WHEN e[m + 1] BETWEEN 6 AND 9 THEN e[m + 1] + 2 WHEN e[m + 1] = 0 THEN 8 ELSE 10 END WHEN e[m + 1] BETWEEN 1 AND 5 THEN e[m + 1] + 2 WHEN e[m + 1] BETWEEN 6 AND 9 THEN {LATEST} + 2 WHEN e[m + 1] = 0 THEN 1 ELSE 12 END AS c FROM q),
 i AS (SELECT sample_id, mtn, CASE WHEN c BETWEEN 8 AND 10 AND (latitude <= -60 OR (latitude BETWEEN 60 AND 82 AND longitude BETWEEN -66 AND -23)) THEN 11 ELSE c END AS c FROM s)
SELECT sample_id, (CASE WHEN mtn >= 1 AND c BETWEEN 3 AND 7 THEN 17 WHEN mtn >= 1 AND c BETWEEN 8 AND 11 THEN 18 ELSE c END)::INT AS surface_type FROM i""")
def f19(spark, sf):
    i = F.col("sample_id")
    snow = F.element_at(F.array(*(F.lit(v) for v in (0, 1, 2, 3, 5, 2, 1))), (i % 7).cast("int") + 1)
    months = F.array(*(((i * (k + 3) + k) % 11).cast("int") for k in range(12)))
    base = surface.classify((i * 13 % 103 - 2).cast("int"), snow, months, (i % 12).cast("int"))
    whole = surface.mountains(surface.ice_sheets(base, F.col("latitude"), F.col("longitude")), (i % 3).cast("int"))
    return obs(spark, sf).select("sample_id", whole.cast("int").alias("surface_type"))


CENTRE = f"t AS (SELECT granule, scan, avg(lat) AS lat, avg(lon) AS lon FROM swath GROUP BY ALL), l AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM t WINDOW w AS (PARTITION BY granule ORDER BY scan)), d AS (SELECT *, sum(CASE WHEN la IS NULL THEN 0 ELSE {HAV.format(a='la', b='lat', c='lo', d='lon')} END) OVER (PARTITION BY granule ORDER BY scan) AS far FROM l), n AS (SELECT *, lead(far) OVER w AS far1, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM d WINDOW w AS (PARTITION BY granule ORDER BY scan))"


@query("g07_centre_track", f"WITH {SWATH_SQL}, {CENTRE} SELECT granule, r.range AS row, round(lat + (r.range * 5 - far) / (far1 - far) * (lat1 - lat), 6) AS lat, round(lon + (r.range * 5 - far) / (far1 - far) * (lon1 - lon), 6) AS lon FROM n JOIN range(200) r ON r.range * 5 >= far AND r.range * 5 < far1")
def g07c(spark, sf):
    """The middle of the swath every 5 km."""
    return rounded(_track(spark, sf))


def _track(spark, sf):
    from orbitframe.operators import fields

    middle = swath(spark, sf).groupBy("granule", "scan").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return fields.track(middle, ["granule"], "scan", "lat", "lon", 5.0)


@query("g07_swath_grid")
def g07(spark, sf):
    from orbitframe.operators import fields

    return rounded(fields.swath_grid(_track(spark, sf), ["granule"], 20, 5.0))


@query("g13_windows")
def g13(spark, sf):
    from orbitframe.operators import fields

    return fields.windows(obs(spark, sf).withColumn("v", F.when(F.col("rqi") > 0.2, F.col("tcwv"))), "granule", "scan", "pixel", "v", 12, 0.8)


@query("d06_collected_results", f"WITH {SWATH_SQL}, {PAIRS}, a AS (SELECT left_id, arg_min(sample_id, distance) AS sample_id FROM pairs WHERE distance <= 20 GROUP BY left_id) SELECT 'reference' AS grp, sample_id AS left_id, surface_precip_ref AS precip FROM swath WHERE surface_precip_ref IS NOT NULL UNION ALL SELECT 'near', left_id, o.surface_precip FROM a JOIN other o USING (sample_id) WHERE o.surface_precip IS NOT NULL UNION ALL SELECT 'own', sample_id, surface_precip FROM swath WHERE sample_id % 3 = 0 AND surface_precip IS NOT NULL")
def d06(spark, sf):
    """The reference grid with the results of each algorithm on it, one group after another."""
    near = _nearest(_left(spark, sf), other_swath(spark, sf), "left_id", "sample_id", AT, AT2, 20.0).join(other_swath(spark, sf).select("sample_id", "surface_precip"), "sample_id")
    df = swath(spark, sf).withColumn("left_id", F.col("sample_id"))
    parts = {"reference": df.select("left_id", F.col("surface_precip_ref").alias("precip")), "near": near.select("left_id", F.col("surface_precip").alias("precip")), "own": df.where("sample_id % 3 = 0").select("left_id", F.col("surface_precip").alias("precip"))}
    out = None
    for name, part in parts.items():
        part = part.where("precip is not null").select(F.lit(name).alias("grp"), "left_id", "precip")
        out = part if out is None else out.unionByName(part)
    return out


@query("s24_collocation_samples", f"WITH {OBS_SQL} SELECT grp, sample_id, surface_precip, surface_precip_ref, month(scan_time)::INT AS month FROM obs WHERE surface_precip >= 0 AND surface_precip_ref >= 0 AND rqi >= 0.2")
def s24(spark, sf):
    """The long sample table of stored collocations: the groups' rows with valid values on both sides."""
    df = obs(spark, sf).where("surface_precip >= 0 and surface_precip_ref >= 0 and rqi >= 0.2")
    return df.select("grp", "sample_id", "surface_precip", "surface_precip_ref", F.month("scan_time").alias("month"))
