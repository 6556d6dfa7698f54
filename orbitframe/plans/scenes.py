"""Queries of scenes: reprojection to another geometry, tiled convolutions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orbitframe.operators import reproject, tiles
from orbitframe.plans.matching import MHS, ecef_sql
from orbitframe.plans.registry import _SQL, query
from orbitframe.plans.verification import rounded
from orbitframe.sources import rasters, store
from orbitframe.sources.fixtures import OBS_SQL, SWATH_SQL, obs, swath

HEIGHT, WIDTH, POSITION, CENTRE, DOWN = 8, 9, 0.5, 12, 0.4


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def places_sql() -> str:
    """The window's places in the swath, step by step."""
    ratio = f"{MHS.ratio!r}::DOUBLE"
    radius = "6371000.0::DOUBLE"
    middle = f"(round_even(({MHS.pixels} - {WIDTH}) * {POSITION}::DOUBLE + {WIDTH} / 2, 0))"
    beta = lambda p: f"radians(({p} - {MHS.pixels // 2}) / {float(MHS.pixels)}::DOUBLE * {float(MHS.scan_range)}::DOUBLE)"
    place = lambda p: f"({radius} * (asin(sin({beta(p)}) * {ratio}) - {beta(p)}))"
    return f"""{SWATH_SQL},
    size AS (SELECT granule, max(scan) + 1 AS n, max(pixel) + 1 AS m FROM swath GROUP BY granule),
    two AS (SELECT s.granule, n, scan - n // 2 AS k, pixel AS j, pixel = m // 2 AS mid, lat, lon, {ecef_sql('lat', 'lon')} AS e FROM swath s JOIN size USING (granule) WHERE scan BETWEEN n // 2 AND n // 2 + 1),
    o AS (SELECT a.granule, a.n, a.e AS o, list_transform([1, 2, 3], lambda i: b.e[i] - a.e[i]) AS f,
          [cos(radians(a.lat)) * cos(radians(a.lon)), cos(radians(a.lat)) * sin(radians(a.lon)), sin(radians(a.lat))] AS u FROM two a JOIN two b USING (granule) WHERE a.mid AND b.mid AND a.k = 0 AND b.k = 1),
    v AS (SELECT granule, n, o, sqrt({_dot('f', 'f')}) AS step, list_transform(f, lambda c: c / sqrt({_dot('f', 'f')})) AS a, u FROM o),
    w AS (SELECT *, [a[2] * u[3] - a[3] * u[2], a[3] * u[1] - a[1] * u[3], a[1] * u[2] - a[2] * u[1]] AS r FROM v),
    p AS (SELECT granule, j, step, w.n, {_dot('list_transform([1, 2, 3], lambda i: e[i] - o[i])', 'r')} AS x, {_dot('list_transform([1, 2, 3], lambda i: e[i] - o[i])', 'a')} AS y FROM two JOIN w USING (granule) WHERE k = 0),
    gap AS (SELECT a.granule, a.j, a.x AS x0, b.x AS x1, a.y AS y0, b.y AS y1 FROM p a JOIN p b ON a.granule = b.granule AND b.j = a.j + 1),
    c AS (SELECT granule, step, n, y AS y0, col, x + {place(f"({middle} + col - {WIDTH // 2})")} - {place(middle)} AS x FROM p, (SELECT unnest(range({WIDTH})) AS col) WHERE j = {CENTRE}),
    q AS (SELECT c.granule, c.col, arg_min(j + (x - x0) / (x1 - x0), j) AS pixel, arg_min(gap.y0 + (x - x0) / (x1 - x0) * (y1 - gap.y0), j) AS y FROM c JOIN gap ON c.granule = gap.granule AND c.x BETWEEN least(x0, x1) AND greatest(x0, x1) GROUP BY ALL),
    z AS (SELECT c.granule, row, c.col, n, ((row - {HEIGHT // 2}) * {float(MHS.scan_offset)}::DOUBLE + c.y0 - q.y) / step + n // 2 AS scan, pixel FROM c LEFT JOIN q ON c.granule = q.granule AND c.col = q.col, (SELECT unnest(range({HEIGHT})) AS row)),
    places AS (SELECT granule, row, col, scan - min(scan) OVER g + {DOWN}::DOUBLE * (n - 1 - max(scan) OVER g + min(scan) OVER g) AS scan, pixel FROM z WINDOW g AS (PARTITION BY granule))"""


def _places(spark, sf):
    found = reproject.swath_places(swath(spark, sf), ["granule"], "scan", "pixel", "lat", "lon")
    return reproject.window_places(found, ["granule"], MHS, HEIGHT, WIDTH, POSITION, CENTRE, DOWN)


@query("g08_window_places", f"WITH {places_sql()} SELECT granule, row::INT AS row, col::INT AS col, round(scan, 4) AS scan, round(pixel, 4) AS pixel FROM places")
def g08p(spark, sf):
    """Where the pixels of a window of a cross-track scanner lie in each swath."""
    return _places(spark, sf).select("granule", "row", "col", F.round("scan", 4).alias("scan"), F.round("pixel", 4).alias("pixel"))


@query("g08_reprojected", f"""WITH {places_sql()}, k AS (SELECT *, floor(scan)::BIGINT AS i, floor(pixel)::BIGINT AS j, scan - floor(scan) AS u, pixel - floor(pixel) AS v FROM places)
    SELECT k.granule, row::INT AS row, col::INT AS col, round(a.tcwv * (1 - u) * (1 - v) + b.tcwv * (1 - u) * v + c.tcwv * u * (1 - v) + d.tcwv * u * v, 4) AS tcwv FROM k
    LEFT JOIN swath a ON a.granule = k.granule AND a.scan = i AND a.pixel = j LEFT JOIN swath b ON b.granule = k.granule AND b.scan = i AND b.pixel = j + 1
    LEFT JOIN swath c ON c.granule = k.granule AND c.scan = i + 1 AND c.pixel = j LEFT JOIN swath d ON d.granule = k.granule AND d.scan = i + 1 AND d.pixel = j + 1""")
def g08(spark, sf):
    """Water vapour on the window, bilinear."""
    return reproject.remap(_places(spark, sf), swath(spark, sf), ["granule"], "scan", "pixel", "tcwv").select("granule", "row", "col", F.round("tcwv", 4).alias("tcwv"))


@query("g08_reprojected_nearest", f"WITH {places_sql()} SELECT k.granule, row::INT AS row, col::INT AS col, a.surface_precip FROM places k LEFT JOIN swath a ON a.granule = k.granule AND a.scan = floor(k.scan + 0.5) AND a.pixel = floor(k.pixel + 0.5)")
def g08n(spark, sf):
    """Precipitation on the window, of the nearest pixel."""
    return reproject.remap(_places(spark, sf), swath(spark, sf), ["granule"], "scan", "pixel", "surface_precip", 0)


ONE = [{"w": np.ones((1, 1, 1, 1))}]


@query("g10_tiles_of_both_axes", f"WITH {OBS_SQL} SELECT granule, scan, pixel, round(tcwv, 6) AS tcwv FROM obs")
def g10(spark, sf):
    """A network that changes nothing gives the scene back, whatever the tiles."""
    return rounded(tiles.score(obs(spark, sf), ["granule"], "scan", "pixel", ["tcwv"], ONE, ["tcwv"], (16, 10), (4, 3)))


@query("m08_tiled_convolution", f"""WITH {OBS_SQL}, n AS (SELECT a.granule, a.scan, a.pixel, sum(b.tcwv) AS s, sum(b.t2m * (2 + b.pixel - a.pixel)) AS t FROM obs a
    JOIN obs b ON a.granule = b.granule AND b.scan BETWEEN a.scan - 1 AND a.scan + 1 AND b.pixel BETWEEN a.pixel - 1 AND a.pixel + 1 GROUP BY ALL)
    SELECT granule, scan, pixel, round(s / 9 + 0.5, 6) AS mean, round(greatest(s / 9 + 0.5, 0) - t / 100, 6) AS mixed FROM n""".replace("greatest(s / 9 + 0.5, 0) - t / 100", "t / 100 - s"))
def m08t(spark, sf):
    """Sums of 3 x 3 pixels and a tilted mean of two channels: tiles whose ramps begin at 0 answer as the whole scene does."""
    w = np.zeros((2, 2, 3, 3))
    w[0, 0], w[1, 0], w[1, 1] = 1 / 9, -1, np.array([1, 2, 3]) / 100
    return rounded(tiles.score(obs(spark, sf), ["granule"], "scan", "pixel", ["tcwv", "t2m"], [{"w": w, "b": np.array([0.5, 0])}], ["mean", "mixed"], (12, 11), (4, 4)))


@query("m08_tiled_fine_rows", f"WITH {OBS_SQL} SELECT granule, scan * 3 + k AS scan, pixel, round(tcwv, 6) AS tcwv FROM obs, (SELECT unnest(range(3)) AS k)")
def m08f(spark, sf):
    """Three rows of answers for each scan."""
    return rounded(tiles.score(obs(spark, sf), ["granule"], "scan", "pixel", ["tcwv"], [{"w": np.ones((1, 1, 1, 1)), "rows": 3}], ["tcwv"], (16, 10), (4, 3)))


def _cell_sql(step: int) -> str:
    return f"SELECT floor((90 - latitude) / {step}) AS r, floor((longitude + 180) / {step}) AS c, max(sample_id) AS v FROM obs GROUP BY ALL"


def _cells(spark, sf, step: int):
    """The last sample in each cell of the grid; those without a place or beyond the grid are in no cell."""
    row, col = F.floor((90 - F.col("latitude")) / step).cast("int"), F.floor((F.col("longitude") + 180) / step).cast("int")
    inside = row.between(0, 180 // step - 1) & col.between(0, 360 // step - 1)
    return obs(spark, sf).where(inside).groupBy(row.alias("row"), col.alias("col")).agg(F.max("sample_id").alias("v"))


SHAPES = {"land": (90, 180), "snow": (45, 90), "emissivity": (18, 36), "mountain": (45, 90)}
_CLASSES = _SQL["f19_surface_classes"].partition("\n s AS")[2]


@query("s17_surface_map", f"""WITH {OBS_SQL}, a AS ({_cell_sql(2)}), b AS ({_cell_sql(4)}), d AS ({_cell_sql(10)}),
    q AS (SELECT y * 180 + x AS sample_id, 90 - (y + 1) * 2.0::DOUBLE AS latitude, -180 + x * 2.0::DOUBLE AS longitude, coalesce(a.v % 103 - 2, 0)::INT AS land, coalesce(b.v % 4, 0)::INT AS snow,
    list_transform(range(12), lambda k: coalesce((d.v * (k + 3) + k) % 11, 0)::INT) AS e, 4 AS m, coalesce(b.v % 5 // 3, 0)::INT AS mtn
    FROM (SELECT unnest(range(90)) AS y), (SELECT unnest(range(180)) AS x) LEFT JOIN a ON a.r = y AND a.c = x LEFT JOIN b ON b.r = y // 2 AND b.c = x // 2 LEFT JOIN d ON d.r = y // 5 AND d.c = x // 5),
 s AS{_CLASSES}""")
def s17(spark, sf):
    """Land, snow, mountain and twelve emissivity rasters of three resolutions, written as files, read and joined to a map of surface classes."""
    root = store.workspace(spark, "rasters")
    fine, half, coarse = (_cells(spark, sf, s) for s in (2, 4, 10))
    months = coarse.select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"), "row", "col", "v")
    files = {
        "land": (fine.select(F.lit("land_2").alias("file"), "row", "col", (F.col("v") % 103 - 2).alias("value")), "i1"), "snow": (half.select(F.lit("snow").alias("file"), "row", "col", (F.col("v") % 4).alias("value")), "i1"),
        "mountain": (half.select(F.lit("mountain").alias("file"), "row", "col", F.floor(F.col("v") % 5 / 3).alias("value")), "i1"),
        "emissivity": (months.select(F.format_string("emiss_class_%02d.dat", F.col("k") + 1).alias("file"), "row", "col", ((F.col("v") * (F.col("k") + 3) + F.col("k")) % 11).alias("value")), "i2"),
    }
    names = {"land": ["land_2"], "snow": ["snow"], "mountain": ["mountain"], "emissivity": [f"emiss_class_{k:02}.dat" for k in range(1, 13)]}
    back = {}
    for name, (cells, kind) in files.items():
        rasters.write(cells, f"{root}/{name}", *SHAPES[name], kind, files=names[name])
        back[name] = rasters.read(spark, f"{root}/{name}", *SHAPES[name], kind, maxPartitionBytes="5000")
    emissivity = back["emissivity"].withColumn("month", F.regexp_extract("file", r"_(\d\d)\.dat", 1).cast("int") - 1)
    found = rasters.surface_map(back["land"], back["snow"], emissivity, back["mountain"], SHAPES, 4)
    return found.select((F.col("row") * 180 + F.col("col")).cast("long").alias("sample_id"), "surface_type")
