"""Round trips of records, streams that equal batches, scores that equal numpy."""

import numpy as np
from pyspark.sql import functions as F

from orbitframe.operators import score, stats
from orbitframe.sources import records
from orbitframe.streaming import incremental


def test_records_round_trip(spark, tmp_path):
    layout = np.dtype([("scan", "<i4"), ("tb", "<f4", (3,)), ("precip", "<f4")])
    df = spark.range(50).select((F.col("id") % 2).cast("int").alias("granule"), F.col("id").cast("int").alias("scan"), F.array(*(F.col("id").cast("float") + k for k in range(3))).alias("tb"), F.when(F.col("id") % 5 == 0, -9999.0).otherwise(F.col("id") / 10).cast("float").alias("precip"))
    for r in records.encode(df, "granule", "scan", layout, b"HEAD").collect():
        (tmp_path / f"g{r['granule']}.bin").write_bytes(bytes(r["content"]) + b"xx")
    back = records.null_missing(records.read(spark, str(tmp_path), layout, 4), ["precip"])
    assert back.count() == 50 and back.where("precip is null").count() == 10
    assert {(r["scan"], tuple(r["tb"])) for r in back.collect()} == {(i, (i, i + 1.0, i + 2.0)) for i in range(50)}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 0.5).alias("v"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    incremental.accumulate(stream, {"k": F.col("k")}, F.col("v"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r["k"]: (r["n"], r["total"]) for r in incremental.accumulated(spark, str(tmp_path / "out")).collect()}
    assert got == {r["k"]: (r["n"], r["total"]) for r in stats.partial(df, {"k": F.col("k")}, F.col("v")).collect()}


def test_score_equals_numpy(spark):
    r = np.random.default_rng(0)
    layers = [{"w": r.normal(size=(4, 8))}, {"w": r.normal(size=(8, 8)), "b": r.normal(size=8)}, {"w": r.normal(size=(8, 3))}]
    x = r.normal(size=(20, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, x array<double>")
    got = {row["id"]: row["quantiles"] for row in score.score(df, "x", layers).collect()}
    assert got[99] is None and np.allclose([got[i] for i in range(20)], score.forward(x, layers))


def _stream(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_hourly_and_scenes_equal_batches(spark, tmp_path):
    df = spark.range(400).select((F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 97 + F.when(F.col("id") > 200, 4000).otherwise(0))).alias("t"), (F.col("id") % 2).alias("k"), (F.col("id") * 0.5).alias("v"))
    stream = _stream(spark, df, str(tmp_path / "in"))
    q = incremental.hourly(stream, "t", ["k"], "v", "10 days").writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    want = df.groupBy(F.date_trunc("hour", "t").alias("hour"), "k").agg(F.count("v").alias("n"), F.sum("v").alias("total"))
    assert sorted(map(str, spark.table("hourly").collect())) == sorted(map(str, want.collect()))
    q = incremental.scenes(stream, "t", "k", "30 minutes", "10 days").writeStream.outputMode("complete").format("memory").queryName("scenes").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted((r["k"], r["n"]) for r in spark.table("scenes").collect()) == [(0, 99), (0, 101), (1, 99), (1, 101)] or sorted(r["n"] for r in spark.table("scenes").collect()) == sorted(r["n"] for r in df.withColumn("late", F.col("t") > F.timestamp_seconds(F.lit(1_600_000_000 + 200 * 97 + 2000))).groupBy("k", "late").agg(F.count("*").alias("n")).collect())


def test_closest_frames_of_a_stream(spark, tmp_path):
    scans = spark.range(50).select(F.col("id").alias("scan"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 60).alias("scan_time"))
    frames = spark.range(12).select(F.col("id").alias("frame"), F.timestamp_seconds(F.lit(1_600_000_010) + F.col("id") * 300).alias("frame_time"))
    pairs = incremental.frames_near(_stream(spark, scans, str(tmp_path / "a")), _stream(spark, frames, str(tmp_path / "b")), 300, "2 days")
    q = pairs.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r["scan"]: r["frame"] for r in incremental.closest_frame(spark.table("pairs"), "scan", "frame").collect()}
    assert got == {s: min(range(12), key=lambda f: (abs(s * 60 - 10 - f * 300), f)) for s in range(50)}


def test_heads_gradients_transfer(spark):
    r = np.random.default_rng(0)
    trunk, tails = [{"w": r.normal(size=(4, 8))}, {"w": r.normal(size=(8, 8))}], {"a": [{"w": r.normal(size=(8, 3))}], "b": [{"w": r.normal(size=(8, 2))}]}
    x = r.normal(size=(20, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, x array<double>")
    got = {row["id"]: row for row in score.score_heads(df, "x", trunk, tails).collect()}
    want = score.heads(x, trunk, tails)
    assert got[99]["a"] is None and all(np.allclose(got[i]["a"], want["a"][i]) and np.allclose(got[i]["b"], want["b"][i]) for i in range(20))
    linear = [{"w": np.array([[1.0, 3.0], [2.0, 4.0]])}]
    two = spark.createDataFrame([(0, [0.5, 0.1])], "id int, x array<double>")
    assert np.allclose(score.score_gradient(two, "x", linear).first()["gradient"], [2.0, 3.0])
    moved = score.transfer(linear, {0: 1, 2: 0}, 3)
    assert np.allclose(score.forward(np.array([[0.1, 7.0, 0.5]]), moved), score.forward(np.array([[0.5, 0.1]]), linear))
    done = score.finalise(score.score_gradient(two, "x", linear), F.get("x", F.lit(0)) > 1, ["gradient"], "id", df.select("id")).collect()
    assert len(done) == 21 and all(r["gradient"] is None for r in done)


def test_swath_grid_has_equal_distances(spark):
    from orbitframe.functions.geo import great_circle
    from orbitframe.plans import registry

    g = registry.queries()["g07_swath_grid"](spark, "/root/testdata/sf0.001")
    right = g.select("granule", "row", (F.col("col") - 1).alias("col"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    d = g.join(right, ["granule", "row", "col"]).select(great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("d"))
    assert d.where(F.abs(F.col("d") - 5) > 0.01).count() == 0 and g.select("col").distinct().count() == 41


def test_scenes_and_windows(spark):
    from orbitframe.operators import fields, sampling

    df = spark.range(40 * 30).select(F.lit(7).alias("g"), F.expr("cast(id div 30 as int)").alias("y"), F.expr("cast(id % 30 as int)").alias("x"), F.when(F.col("id") % 5 != 0, F.col("id") * 1.0).alias("v"))
    got = sampling.scenes(df, "g", "y", "x", "v", 10, 20).collect()
    covered = {(r["y0"] + i, r["x0"] + j) for r in got for i in range(10) for j in range(10)}
    assert covered >= {(y, x) for y in range(40) for x in range(30) if x % 5} and all(0 <= r["y0"] <= 30 and 0 <= r["x0"] <= 20 for r in got)
    assert {(r["y0"], r["x0"]) for r in fields.windows(df, "g", "y", "x", "v", 10, 0.7).collect()} == {(y, x) for y in (0, 10, 20, 30) for x in (0, 10, 20)}
    assert fields.windows(df, "g", "y", "x", "v", 10, 0.9).count() == 0


def test_formats_of_names():
    import pytest

    from orbitframe.sources import granules

    names = {"gpm_12.bin": "a-priori", "x/2A.GMI.bin.gz": "retrieval", "a.pp": "preprocessor", "b/1C.GPM.HDF5": "l1c", "c.sim": "simulator", "d.nc.lz4": "netcdf"}
    assert {n: granules.format_of(n) for n in names} == names
    with pytest.raises(ValueError):
        granules.format_of("x.txt")


def test_granule_files_gzipped(spark, tmp_path):
    """A gzipped file reads as a plain one, and what is cut off is left out."""
    import gzip

    from orbitframe.sources import granules, layouts

    kinds = (layouts.preprocessor_header(11), layouts.PREPROCESSOR_SCAN, layouts.preprocessor_pixel(11, False))
    df = spark.range(60).select(F.lit(3).alias("granule"), F.expr("cast(id div 6 as int)").alias("scan"), F.expr("cast(id % 6 as int)").alias("pixel"), F.col("id").cast("float").alias("latitude"))
    content = bytes(granules.pack(df, *kinds).first()["content"])
    (tmp_path / "a.pp.gz").write_bytes(gzip.compress(content))
    (tmp_path / "b.pp").write_bytes(content[:-5])
    got = granules.read_scans(granules.files(spark, str(tmp_path)), *kinds).groupBy(F.regexp_extract("path", "([ab])[.]pp", 1).alias("f")).agg(F.count("*").alias("n"), F.sum("latitude").alias("s")).collect()
    assert {r["f"]: (r["n"], r["s"]) for r in got} == {"a": (60, 1770.0), "b": (54, 1431.0)}


def test_files_reach_python_in_pieces(spark):
    """No piece that Python gets is larger than some records or a scan, and only scans that are asked for are passed on."""
    from orbitframe.sources import granules, layouts

    layout = np.dtype([("scan", "<i4"), ("tb", "<f4", (3,)), ("rest", "<f4", (5,))])
    df = spark.range(5000).select(F.lit(1).alias("granule"), F.col("id").cast("int").alias("scan"), F.array(*(F.col("id").cast("float") + k for k in range(3))).alias("tb"))
    files = records.encode(df, "granule", "scan", layout).select(F.col("granule").cast("string").alias("path"), "content")
    out = records.decode(files, layout)
    assert {(r["record"], r["scan"], tuple(r["tb"]), sum(r["rest"])) for r in out.collect()} == {(i, i, (i, i + 1.0, i + 2.0), 0.0) for i in range(5000)}
    assert "substring" in out._jdf.queryExecution().optimizedPlan().toString()
    kinds = (layouts.preprocessor_header(), layouts.PREPROCESSOR_SCAN, layouts.preprocessor_pixel())
    pixels = spark.range(3 * 40 * 5).select((F.col("id") % 3 + 70_000).cast("int").alias("granule"), (F.col("id") / 3 % 40).cast("int").alias("scan"), (F.col("id") / 120).cast("int").alias("pixel"), F.col("id").cast("float").alias("latitude"))
    back = granules.read_scans(granules.pack(pixels, *kinds), *kinds, scans=F.col("scan") >= 38)
    assert sorted(back.select(pixels.columns).collect()) == sorted(pixels.where("scan >= 38").collect())
    assert "Filter (scan" not in back._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]
