"""Properties that hold without a reference: inverses, identities, analytic signals."""

import numpy as np
from pyspark.sql import functions as F

from orbitframe.functions import bins, geo, physics
from orbitframe.operators import grid, sequence, stats
from orbitframe.plans import registry


def test_ecef_round_trip(spark):
    df = spark.createDataFrame([(a, b) for a in (-89.0, -30.5, 0.0, 45.25, 88.0) for b in (-179.5, -10.0, 0.0, 120.0)], "lat double, lon double")
    df = df.select("lat", "lon", *(c.alias(k) for k, c in zip("xyz", geo.ecef(F.col("lat"), F.col("lon")), strict=True)))
    lat, lon = geo.latlon(F.col("x"), F.col("y"), F.col("z"))
    r = df.select(F.max(F.abs(lat - F.col("lat"))), F.max(F.abs(lon - F.col("lon")))).first()
    assert max(r) < 1e-6


def test_histogram_edges(spark):
    values = [-1.0, 0.0, 0.5, 1.0, 3.999, 4.0, 4.001, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(bins.uniform_bin(F.col("v"), 0.0, 4.0, 4)).collect()]
    assert got == [None, 0, 0, 1, 3, 3, None, None]
    got = [r[0] for r in df.select(bins.edge_bin(F.col("v"), [0.0, 1.0, 4.0])).collect()]
    assert got == [None, 0, 0, 1, 1, 1, None, None]


def test_merge_of_same_input_doubles(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(10)], "k int, v double")
    one = stats.partial(df, {"k": F.col("k")}, F.col("v"))
    a = {r["k"]: (r["n"], r["total"]) for r in one.collect()}
    b = {r["k"]: (r["n"], r["total"]) for r in stats.merge(one, one).collect()}
    assert b == {k: (2 * n, 2 * t) for k, (n, t) in a.items()}


def test_interpolation_weights_descending(spark):
    df = spark.createDataFrame([(60.0,), (50.0,), (25.0,), (0.0,), (-5.0,)], "x double")
    got = [r[0] for r in df.select(physics.interpolation_weights(F.col("x"), [50.0, 30.0, 20.0, 0.0])).collect()]
    assert np.allclose(got, [[1, 0, 0, 0], [1, 0, 0, 0], [0, 0.5, 0.5, 0], [0, 0, 0, 1], [0, 0, 0, 1]])


def test_exceedance(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0],)], "q array<double>")
    assert abs(df.select(physics.exceedance(F.col("q"), [0.25, 0.5, 0.75], 1.5)).first()[0] - 0.375) < 1e-12


def test_tiles_assemble_to_input(spark):
    assert sequence.tiles(382, 64, 16)[-1] == 382 - 64
    df = spark.range(111).select(F.lit(0).alias("g"), F.col("id").alias("scan"), (F.col("id") * 1.0).alias("v"))
    out = sequence.assemble(df, ["g"], "scan", "v", 111, 32, 8)
    assert out.where(F.abs(F.col("v") - F.col("scan")) > 1e-9).count() == 0 and out.count() == 111


def test_cosine_has_its_energy_at_its_scale():
    c = grid.dct_matrix(64)
    assert np.allclose(c @ c.T, np.eye(64))
    x = np.cos(np.pi * 4 * (np.arange(64) + 0.5) / 64)
    assert np.argmax(np.abs(c @ x)) == 4


def test_pr_curve_orders_thresholds_inside_ranges(spark):
    """No window takes all thresholds into one task."""
    plan = registry.queries()["a39_pr_curve"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(p#" in plan and "windowspecdefinition(threshold#" not in plan


def test_rounding_keeps_the_sign_of_zero(spark):
    import duckdb

    from orbitframe.functions.clean import signed_round

    values = [-3.0e-7, -0.0, 0.0, 3.0e-7, -5.0e-7, 0.0078125, -0.0078125, -1.25, None, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["v"] for r in df.select("i", signed_round(F.col("v"), 6).alias("v")).orderBy("i").collect()]
    assert list(map(repr, got)) == [repr(None if v is None else duckdb.execute("select round(?::DOUBLE, 6)", [v]).fetchone()[0]) for v in values]


def test_pair_average_near_zero(spark, tmp_path):
    from orbitframe.plans import registry

    spark.createDataFrame([(1, [-3e-7, -1e-7, 1e-7, 1e-7] + [0.5] * 60, 0)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert list(map(repr, registry.queries()["w07_pair_average"](spark, str(tmp_path)).first()["profile"][:3])) == ["-0.0", "0.0", "0.5"]
