"""Bins are pruned by folder, statically and by a list; granules are found by time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import intervals
from orbitframe.sources import bins


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bins") / "t")
    df = spark.range(4000).select(F.col("id").alias("key"), (227 + F.col("id") * 7 % 81).cast("int").alias("t2m_bin"), (F.col("id") * 13 % 77).cast("int").alias("tcwv_bin"), (F.col("id") % 18 + 1).cast("int").alias("surface_type"))
    bins.write(df, path)
    return df, path


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def files(df):
    return len(df.select(F.input_file_name()).distinct().collect())


def test_ranges_read_their_folders(spark, table):
    df, path = table
    some, all_ = bins.read(spark, path, (245, 252), (12, 18)), bins.read(spark, path)
    want = df.where("t2m_bin between 245 and 252 and tcwv_bin between 12 and 18")
    assert sorted(some.collect()) == sorted(want.collect()) and all_.count() == 4000
    text = plan(some)
    assert "PartitionFilters: [isnotnull(t2m_cell" in text and "PushedFilters: [IsNotNull(t2m_bin)" in text
    assert files(some) <= 2 < files(bins.read(spark, path, (245, 280), (12, 48))) < files(all_)


def test_a_list_prunes_when_the_query_runs(spark, table):
    df, path = table
    wanted = spark.read.parquet(path).where("key in (3, 17, 1200)")
    got = bins.read_listed(spark, path, wanted)
    want = df.join(df.where("key in (3, 17, 1200)").select("t2m_bin", "tcwv_bin").distinct(), ["t2m_bin", "tcwv_bin"]).select(got.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    assert "dynamicpruning" in plan(got)


def test_a_crowded_folder_is_split(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        df = spark.range(40_000).select(F.col("id").alias("key"), F.lit(250).alias("t2m_bin"), F.lit(20).alias("tcwv_bin"), F.lit(1).alias("surface_type"))
        bins.write(df, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert bins.read(spark, str(tmp_path / "t")).count() == 40_000 and files(bins.read(spark, str(tmp_path / "t"))) > 1


def test_fraction_of_bins(spark, table):
    df, path = table
    parts = [bins.fraction(bins.read(spark, path), "key", a, b) for a, b in ((0.0, 0.5), (0.5, 1.0))]
    assert sorted(parts[0].union(parts[1]).collect()) == sorted(bins.read(spark, path).collect())


def test_granules_by_time(spark):
    t = lambda h, m=0: dt.datetime(2020, 1, 1) + dt.timedelta(hours=h, minutes=m)
    catalogue = spark.createDataFrame([("a", t(0), t(1, 30)), ("b", t(1), t(2, 40)), ("c", t(5), t(30)), ("d", t(23), t(0, 20))], "file string, start timestamp, stop timestamp").withColumn("stop", intervals.unwrapped(F.col("start"), F.col("stop")))
    points = spark.createDataFrame([(1, t(0)), (2, t(1, 30)), (3, t(3)), (4, t(29)), (5, t(24, 10)), (6, t(-1))], "id int, at timestamp")
    got = {r["id"]: (r["n"], r["file"]) for r in intervals.first_at(points, catalogue, [], "id", "at", "start", "stop", "file").collect()}
    assert got == {1: (1, "a"), 2: (2, "a"), 3: (0, None), 4: (1, "c"), 5: (2, "c"), 6: (0, None)}


def test_one_file_a_granule(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "granule int, file string")
    assert {tuple(r) for r in intervals.by_number(df, "granule", "file").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="more than one file of granule 2"):
        intervals.by_number(df.union(spark.createDataFrame([(2, "c")], df.schema)), "granule", "file").collect()


def test_crowded_times_need_no_pairs(spark):
    """Where all intervals overlap, each point is still one row: no join, and the answers of brute force. Rows without a key meet nothing."""
    base, n = dt.datetime(2020, 1, 1), 120
    spans = [(i % 2 if i % 17 else None, base + dt.timedelta(minutes=i * 37 % 90), base + dt.timedelta(minutes=i * 37 % 90 + i % 50 - 2), f"f{i * 7 % n:03}") for i in range(n)]
    points = [(k, k % 2 if k % 19 else None, base + dt.timedelta(minutes=k % 150)) for k in range(600)]
    catalogue = spark.createDataFrame(spans, "s int, t0 timestamp, t1 timestamp, file string")
    out = intervals.first_at(spark.createDataFrame(points, "id int, s int, at timestamp"), catalogue, ["s"], "id", "at", "t0", "t1", "file", 3600)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: (r["n"], r["file"]) for r in out.collect()}
    for k, s, at in points:
        own = [f for t, a, b, f in spans if t == s is not None and a <= at <= b]
        assert found[k] == (len(own), min(own, default=None))


def test_as_of_is_one_row_a_left_row(spark):
    import datetime

    from orbitframe.operators import collocate

    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    left = spark.createDataFrame([(k % 30, day(k)) for k in range(60)], "key int, d date")
    right = spark.createDataFrame([(day(k), v) for k in (3, 10, 11, 40) for v in ("a", f"b{k}")], "t date, v string")
    out = collocate.as_of(left, right, "key", F.col("d"), F.col("t"), F.col("v"), 5)
    want = [(k % 30, next((f"b{t}" for t in (40, 11, 10, 3) if t <= k <= t + 5), None)) for k in range(60)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
