"""Tiles: weights add up, deep networks agree with whole scenes inside; reprojection against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.functions.geometry import CrossTrack
from orbitframe.operators import reproject, tiles


@pytest.mark.parametrize("n, tile, overlap", [(5, 8, 2), (8, 8, 2), (9, 8, 2), (40, 16, 4), (41, 16, 4), (100, 16, 8), (101, 16, 1), (50, 16, 0), (77, 32, 15), (33, 16, 5)])
def test_weights_add_up(spark, n, tile, overlap):
    starts = spark.range(1).select(tiles.starts_of(F.lit(n).cast("long"), tile, overlap).alias("s")).first()["s"]
    size, total = min(tile, n), np.zeros(n)
    assert starts[0] == 0 and starts[-1] + size == n and all(b - a <= tile - overlap for a, b in zip(starts, starts[1:], strict=False))
    for k, s in enumerate(starts):
        total[s : s + size] += tiles.ramp(starts, k, size, overlap)
    assert np.allclose(total, 1)


def test_convolution_of_tiles_is_that_of_the_scene(spark):
    r = np.random.default_rng(1)
    scene = r.normal(size=(2, 45, 33))
    scene[0, 7, 5] = np.nan
    layers = [{"w": r.normal(size=(3, 2, 3, 3)), "b": r.normal(size=3)}, {"w": r.normal(size=(1, 3, 1, 3)), "rows": 3}]
    rows = [(g, y, x, *(None if np.isnan(v) else float(v) * (g + 1) for v in scene[:, y, x])) for g in (0, 1) for y in range(45) for x in range(33)]
    df = spark.createDataFrame(rows, "g int, y int, x int, a double, b double")
    # places whose weight is 0 lie beyond what two layers reach across
    got = tiles.score(df, ["g"], "y", "x", ["a", "b"], layers, ["v"], (20, 16), (1, 1), missing=0.0).collect()
    assert len(got) == 2 * 135 * 33
    near = tiles.score(df, ["g"], "y", "x", ["a", "b"], layers, ["v"], (45, 33), (4, 4), missing=0.0).collect()
    for g in (0, 1):
        want = tiles.convolve(np.nan_to_num(scene) * (g + 1), layers)[0]
        assert all(np.isclose(q["v"], want[q["y"], q["x"]]) for q in near if q["g"] == g)


def test_reprojection_by_numpy(spark):
    geometry = CrossTrack(855_000.0, 98.9, 90, 17_500.0, 1.11)
    lat = lambda y, x: -1 + 0.15 * y + 0.01 * x
    lon = lambda y, x: 20 + 0.17 * x - 0.01 * y
    rows = [(g, y, x, lat(y, x) + g, lon(y, x), float(y * 100 + x)) for g in (0, 1) for y in range(20) for x in range(31)]
    df = spark.createDataFrame(rows, "g int, y int, x int, lat double, lon double, v double")
    track = reproject.swath_places(df, ["g"], "y", "x", "lat", "lon")
    places = reproject.window_places(track, ["g"], geometry, 6, 40, 0.5, 15, 0.0)
    got = {(r["g"], r["row"], r["col"]): r for r in places.collect()}
    t = {r["j"]: r for r in track.where("g = 0").collect()}
    j = np.array(sorted(t))
    across, along = (np.array([t[k][c] for k in j]) for c in ("across", "along"))
    assert abs(across[15]) < 1e-6 and (np.diff(across) > 0).all() or (np.diff(across) < 0).all()
    sign = np.sign(across[-1])
    beta = np.radians((np.arange(90) - 45) / 90 * 98.9)
    ground = 6_371_000.0 * (np.arcsin(np.sin(beta) * geometry.ratio) - beta)
    middle = round((90 - 40) * 0.5 + 20)
    for col in range(40):
        x = ground[middle + col - 20] - ground[middle]
        pixel = np.interp(x * sign, across * sign, j, left=np.nan, right=np.nan)
        assert (got[0, 0, col]["pixel"] is None) == bool(np.isnan(pixel)) and (np.isnan(pixel) or abs(got[0, 0, col]["pixel"] - pixel) < 1e-6)
    assert any(got[0, 0, c]["pixel"] is None for c in range(40)) and min(r["scan"] for r in got.values() if r["g"] == 0 and r["scan"] is not None) == 0
    source = df.where("not (y = 2 and x = 15)")
    for order in (0, 1):
        values = {(r["g"], r["row"], r["col"]): r["v"] for r in reproject.remap(places, source, ["g"], "y", "x", "v", order).collect()}
        assert set(values) == set(got)
        for key, r in got.items():
            if r["pixel"] is None:
                assert values[key] is None
                continue
            y, x = (np.floor(r["scan"] + 0.5), np.floor(r["pixel"] + 0.5)) if order == 0 else (r["scan"], r["pixel"])
            corners = {(np.floor(y) + a, np.floor(x) + b) for a in (0, 1) if not a or y % 1 for b in (0, 1) if not b or x % 1}
            gone = (2, 15) in corners or any(not (0 <= p < 20 and 0 <= q < 31) for p, q in corners)
            assert values[key] is None if gone else abs(values[key] - (y * 100 + x)) < 1e-6
