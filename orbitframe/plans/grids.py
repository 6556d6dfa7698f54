"""Queries of the grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.operators import grid
from orbitframe.plans.registry import query
from orbitframe.plans.verification import rounded
from orbitframe.sources.fixtures import OBS_SQL, obs


@query("g02_smooth", f"WITH {OBS_SQL}, k AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx, exp(-((a.range - 1) ** 2 + (b.range - 1) ** 2) / 2.0::DOUBLE) AS w FROM range(3) a, range(3) b), s AS (SELECT granule, scan + dy AS scan, pixel + dx AS pixel, w, surface_precip AS v FROM obs, k) SELECT o.sample_id, round(sum(w * v) / sum(w) FILTER (WHERE v IS NOT NULL), 6) AS smooth FROM obs o JOIN s USING (granule, scan, pixel) GROUP BY o.sample_id")
def g02(spark, sf):
    df = obs(spark, sf)
    out = grid.smooth(df.select("granule", "scan", "pixel", "surface_precip"), ["granule"], "scan", "pixel", "surface_precip", grid.gaussian(1, 1.0), 0.0)
    return rounded(df.select("sample_id", "granule", "scan", "pixel").join(out, ["granule", "scan", "pixel"], "left").select("sample_id", "smooth"))


@query("g12_padding", f"WITH {OBS_SQL} SELECT granule, ((32 - count(DISTINCT scan) % 32) % 32)::BIGINT AS pad_scans, ((32 - count(DISTINCT pixel) % 32) % 32)::BIGINT AS pad_pixels FROM obs GROUP BY granule")
def g12(spark, sf):
    pad = lambda c: F.pmod(-F.countDistinct(c), F.lit(32))
    return obs(spark, sf).groupBy("granule").agg(pad("scan").alias("pad_scans"), pad("pixel").alias("pad_pixels"))


@query("g15_dilate", f"WITH {OBS_SQL}, i AS (SELECT DISTINCT granule, scan + a.range - 1 AS scan, pixel + b.range - 1 AS pixel FROM obs, range(3) a, range(3) b WHERE surface_type = 2) SELECT sample_id FROM obs JOIN i USING (granule, scan, pixel)")
def g15(spark, sf):
    df = obs(spark, sf)
    return df.select("sample_id", "granule", "scan", "pixel").join(grid.dilate(df.where("surface_type = 2"), ["granule"], "scan", "pixel", 1), ["granule", "scan", "pixel"], "left_semi").select("sample_id")


def _cosine(field: str, place: str, k: str, n: int) -> str:
    return f"sum({field} * cos(pi() * (2 * {place} + 1) * {k} / {2.0 * n}::DOUBLE)) * CASE WHEN {k} = 0 THEN sqrt(1.0::DOUBLE / {n}) ELSE sqrt(2.0::DOUBLE / {n}) END"


SPECTRA = f"""WITH {OBS_SQL}, f AS (SELECT granule, scan AS y, pixel AS x, coalesce(surface_precip, 0) AS a, coalesce(surface_precip_ref, 0) AS b FROM obs),
 r AS (SELECT granule, k.range AS ky, x, {_cosine('a', 'y', 'k.range', 40)} AS a, {_cosine('b', 'y', 'k.range', 40)} AS b FROM f, range(40) k GROUP BY granule, k.range, x),
 c AS (SELECT granule, ky, k.range AS kx, {_cosine('a', 'x', 'k.range', 25)} AS a, {_cosine('b', 'x', 'k.range', 25)} AS b FROM r, range(25) k GROUP BY granule, ky, k.range),
 s AS (SELECT floor(sqrt((ky / 40.0::DOUBLE) ** 2 + (kx / 25.0::DOUBLE) ** 2) * 32)::INT AS scale, sum(a * a) AS ea, sum(b * b) AS eb, sum(a * b) AS ab, sum((a - b) * (a - b)) AS dd, sum(b) AS sb, count(*) AS n FROM c GROUP BY 1)
SELECT scale, round(ea, 3) AS energy, round(eb, 3) AS energy_ref, round(abs(ab) / sqrt(ea * eb), 5) AS coherence, round(ab / sqrt(ea * eb), 5) AS correlation, round(dd / n, 3) AS mse, CASE WHEN n >= 4 THEN round(1 - dd / (eb - sb ** 2 / n), 5) END AS efficiency, n FROM s"""


@query("a44_spectra", SPECTRA)
def a44(spark, sf):
    out = grid.spectra(obs(spark, sf), "granule", "scan", "pixel", "surface_precip", "surface_precip_ref")
    places = {"energy": 3, "energy_ref": 3, "coherence": 5, "correlation": 5, "mse": 3, "efficiency": 5}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@query("g12_replicated_padding", f"WITH {OBS_SQL}, p AS (SELECT granule, a.range - 12 AS y, b.range - 3 AS x FROM (SELECT DISTINCT granule FROM obs), range(64) a, range(32) b) SELECT p.granule, y, x, o.tcwv FROM p JOIN obs o ON o.granule = p.granule AND o.scan = greatest(0, least(39, y)) AND o.pixel = greatest(0, least(24, x))")
def g12r(spark, sf):
    """Granules of 40 x 25 padded to 64 x 32, 12 and 3 places before; the edges are repeated."""
    return grid.pad(obs(spark, sf).select("granule", "scan", "pixel", "tcwv"), ["granule"], "scan", "pixel", (40, 25), 32).select("granule", F.col("scan").alias("y"), F.col("pixel").alias("x"), "tcwv")


@query("g15_isolated", f"WITH {OBS_SQL}, i AS (SELECT granule, scan, pixel, sample_id FROM obs WHERE surface_type IN (2, 3, 5, 7, 11)), n AS (SELECT a.sample_id, count(*) AS near FROM i a JOIN i b ON a.granule = b.granule AND abs(a.scan - b.scan) <= 1 AND abs(a.pixel - b.pixel) <= 1 GROUP BY a.sample_id) SELECT sample_id, near FROM n WHERE near > 2")
def g15i(spark, sf):
    """Ice that has more than one other piece of ice among its eight neighbours."""
    ice = obs(spark, sf).where("surface_type in (2, 3, 5, 7, 11)").select("granule", "scan", "pixel", "sample_id")
    ones = ice.withColumn("one", F.lit(1.0))
    near = grid.smooth(ones, ["granule"], "scan", "pixel", "one", [(dy, dx, 1.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], 0.0, total=True)
    return ice.join(near, ["granule", "scan", "pixel"]).where("smooth > 2").select("sample_id", F.col("smooth").cast("long").alias("near"))


def _filled(value: str, passes: int, source: str) -> str:
    """The passes one after another on a granule's cells as a list; `source` is the list of places that a cell without a value tries."""
    return f"""WITH RECURSIVE {OBS_SQL}, c AS (SELECT granule, sample_id, scan, pixel, {value} AS v FROM obs),
    g AS (SELECT granule, list(v ORDER BY scan, pixel) AS v FROM c GROUP BY granule), s AS (SELECT granule, 0 AS k, v FROM g UNION ALL
    SELECT granule, k + 1, list_transform(range(len(v)), lambda p: coalesce(v[p + 1], {source})) FROM s WHERE k < {passes})
    SELECT sample_id, s.v[scan * 25 + pixel + 1] AS filled FROM c JOIN s USING (granule) WHERE k = {passes}"""


_AT = "CASE WHEN p // 25 + {dy} BETWEEN 0 AND len(v) // 25 - 1 AND p % 25 + {dx} BETWEEN 0 AND 24 THEN v[p + ({dy}) * 25 + ({dx}) + 1] END"
_DIAGONAL = _AT.format(dy="(k // 4 + 1) * [1, -1, 1, -1][k % 4 + 1]", dx="(k // 4 + 1) * [1, 1, -1, -1][k % 4 + 1]")
_AROUND = ", ".join(_AT.format(dy=dy, dx=dx) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dy or dx)


def _cells(spark, sf, keep: str):
    return obs(spark, sf).select("sample_id", "granule", "scan", "pixel", F.when(F.expr(keep), F.col("surface_type").cast("double")).alias("filled"))


def _fill(df, passes):
    from orbitframe.operators import raster

    out = raster.fill(df.drop("sample_id"), ["granule"], "scan", "pixel", "filled", passes, 16)
    return df.select("sample_id", "granule", "scan", "pixel").join(out, ["granule", "scan", "pixel"]).select("sample_id", "filled")


@query("g15_fill_diagonals", _filled("CASE WHEN sample_id % 7 = 0 AND surface_type < 12 THEN surface_type::DOUBLE END", 36, _DIAGONAL))
def g15d(spark, sf):
    """Snow classes with most cells missing, filled along diagonals up to nine cells off, in tiles of 16 cells with their halo."""
    from orbitframe.operators import raster

    return _fill(_cells(spark, sf, "sample_id % 7 = 0 and surface_type < 12"), raster.diagonal())


@query("g15_fill_around", _filled("CASE WHEN sample_id % 11 = 0 AND surface_type < 9 THEN surface_type::DOUBLE END", 4, f"coalesce({_AROUND})"))
def g15a(spark, sf):
    """Emissivity classes filled from their neighbours, four times over."""
    from orbitframe.operators import raster

    return _fill(_cells(spark, sf, "sample_id % 11 = 0 and surface_type < 9"), raster.around())
