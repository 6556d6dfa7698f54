"""Bundles of statistics against numpy, with missing values, empty tables and several runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import presets

COLUMNS = "surface_type int, airmass_type int, latitude double, longitude double, scan_time timestamp, pixel int, t2m double, tcwv double, tb array<double>, surface_precip double, latent_heat array<double>"


@pytest.fixture(scope="module")
def pixels(spark):
    r = np.random.default_rng(5)
    rows = []
    for i in range(400):
        heat = [float(x) for x in r.normal(0, 100, 3)]
        if i % 9 == 0:
            heat[1] = None if i % 2 else -9999.9
        rain = None if i % 11 == 0 else float("nan") if i % 13 == 0 else -9999.9 if i % 17 == 0 else float(r.gamma(0.5, 4))
        rows.append((int(r.integers(0, 20)), int(r.integers(-1, 5)), float(r.uniform(-90, 90)), float(r.uniform(-180, 180)), None, int(r.integers(90, 130)), float(r.uniform(230, 350)), float(r.uniform(0, 90)), [float(x) for x in r.uniform(100, 420, 3)], rain, heat))
    return spark.createDataFrame(rows, COLUMNS), rows


def test_retrieval_equals_numpy(pixels):
    df, rows = pixels
    got = presets.preset(df, "retrieval").collect()
    of = lambda name, target: {(r.k0, r.k1, r.k2): (r.n, r.total) for r in got if r.statistic == name and r.target == target}
    whole = [r for r in rows if all(h is not None and h > -999 for h in r[10])]
    surface = 3
    heat = np.array([h for r in whole if r[0] == surface for h in r[10]])
    want, _ = np.histogram(heat, np.linspace(-500, 500, 201))
    found = {k[2]: n for k, (n, _) in of("histogram", "latent_heat").items() if k[0] == surface}
    assert found == {i: n for i, n in enumerate(want) if n}
    t2m, weight = np.array([(r[6], sum(r[10])) for r in whole if r[0] == surface]).T
    sums, _ = np.histogram(t2m, np.linspace(239.5, 339.5, 101), weights=weight)
    found = {k[1]: total for k, (_, total) in of("by_t2m", "latent_heat").items() if k[0] == surface}
    assert all(np.isclose(sums[i], v) for i, v in found.items()) and np.isclose(sums.sum(), sum(found.values()))
    assert sum(n for n, _ in of("by_tcwv_centre", "latent_heat").values()) == 3 * sum(98 <= r[5] < 123 and 1 <= r[0] <= 18 for r in whole)
    assert sum(n for n, _ in of("zonal", "surface_precip").values()) == sum(r[9] is not None and r[9] > -999 for r in rows)
    assert sum(n for n, _ in of("scan_position", "surface_precip").values()) == len(rows)


def test_runs_add_up_and_unknown_kind(spark, pixels, tmp_path):
    df, _ = pixels
    parts = [df.where("pixel < 100"), df.where("pixel between 100 and 110"), df.where("pixel > 110"), df.where("false")]
    for i, p in enumerate(parts):
        presets.save(presets.preset(p, "combined"), str(tmp_path / str(i)))
    key = lambda r: str(r[:7])
    one, all_ = (sorted(x.collect(), key=key) for x in (presets.preset(df, "combined"), presets.load(spark, *(str(tmp_path / str(i)) for i in range(4)))))
    assert len(one) == len(all_) > 0 and all(a[:8] == b[:8] and (a.total == b.total or np.isclose(a.total, b.total)) for a, b in zip(one, all_, strict=True))
    with pytest.raises(ValueError, match="kind must be"):
        presets.preset(df, "others")
    assert presets.preset(df.where("false"), "training_3d").count() == 0


def test_angles_and_single_angle_surfaces(spark):
    rows = [(1, 9, [[100.5], [200.5]], [1.0, 30.0]), (2, 2, [[150.5]], [5.0]), (2, 9, [[160.5]], [5.0])]  # the third has an angle that the sensor lacks
    df = spark.createDataFrame(rows, "surface_type int, pixel_position int, tb array<array<double>>, surface_precip array<double>")
    df = df.withColumns({"airmass_type": F.lit(0), "t2m": F.lit(280.0), "tcwv": F.lit(10.0)})
    got = {(r.statistic, r.k0, r.k1, r.k2, r.k3): r.n for r in presets.preset(df, "bin", angles=[50.0, 30.0, 10.0]).collect()}
    tb = {k[1:]: n for k, n in got.items() if k[0] == "tb"}
    assert tb == {(1, 0, 0, 100): 1, (1, 0, 1, 200): 1, (2, 0, 1, 150): 1}
    assert {k[1:4]: n for k, n in got.items() if k[0] == "histogram"} == {(1, 0, 0): 1, (1, 1, 12): 1, (2, 1, 2): 1}
    assert got[("by_t2m", 2, 40, None, None)] == 2


def test_arrays_alone_are_exploded(pixels):
    """Cells are not made by a generator, which is not compiled: only columns of arrays are taken apart row by row."""
    df, _ = pixels
    plan = presets.preset(df, "training_1d")._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate " in line]
    assert made and not any("array(" in line or "transform(" in line or "struct(" in line for line in made), made
