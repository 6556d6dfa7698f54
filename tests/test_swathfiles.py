"""Data sources of the swath formats: round trips, bytes read, pushed filters, failures that leave nothing behind."""

import gzip
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.sources import layouts, store, swathfiles as sw


@pytest.fixture(scope="module")
def pixels(spark):
    n = F.col("id").cast("int")
    return spark.range(3 * 20 * 6).select(
        (n % 3).alias("granule"), ((n / 3).cast("int") % 20).alias("scan"), (n / 60).cast("int").alias("pixel"), (n * 0.5).cast("float").alias("latitude"), F.array(*[n.cast("float") + k for k in range(15)]).alias("brightness_temperatures"),
        F.when(n % 7 > 0, n % 18 + 1).cast("tinyint").alias("surface_type"), F.array(*[F.lit(v).cast("smallint") for v in (2019, 3, 4, 5, 6)], ((n / 3).cast("int") % 20).cast("smallint")).alias("scan_date"),
    )


@pytest.fixture(scope="module")
def folder(spark, pixels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pp") / "files")
    sw.write_granules(pixels, "preprocessor", path, **{"header.sensor": "GMI"})
    return path


def as_rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip(spark, pixels, folder):
    assert [x.path.rpartition("/")[2] for x in store.listed(folder)] == ["000000.pp", "000001.pp", "000002.pp"]
    back = sw.read(spark, "preprocessor", folder).select(*pixels.columns)
    assert as_rows(back) == as_rows(pixels.withColumn("surface_type", F.coalesce("surface_type", F.lit(-99).cast("tinyint"))))
    head = np.fromfile(f"{folder}/000001.pp", layouts.preprocessor_header(), 1)[0]
    assert (head["sensor"], head["number_of_scans"], head["number_of_pixels"], head["granule_number"]) == (b"GMI", 20, 6, 1)


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, inner, log):
        self.inner, self.log = inner, log

    def read(self, n):
        found = self.inner.read(n)
        self.log.append(len(found))
        return found

    def seek(self, at):
        return self.inner.seek(at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.inner.close()


def bytes_read(folder, monkeypatch, filters=(), **options):
    from pyspark.sql.types import StructType

    log, real = [], store.resolve

    class Store:
        def __init__(self, system):
            self.system = system

        def open_input_file(self, path):
            return Counted(self.system.open_input_file(path), log)

    monkeypatch.setattr(sw.store, "resolve", lambda path: (Store(real(path)[0]), real(path)[1]))
    reader = sw.Reader("preprocessor", {"path": folder, **options}, StructType.fromDDL("granule int, scan int, pixel int, latitude float"))
    monkeypatch.setattr(sw.store, "resolve", real)
    left = list(reader.pushFilters(list(filters)))
    parts = reader.partitions()
    monkeypatch.setattr(sw.store, "resolve", lambda path: (Store(real(path)[0]), real(path)[1]))
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    monkeypatch.undo()
    return rows, sum(log), left


def test_last_scan_reads_its_bytes_alone(folder, monkeypatch):
    head = layouts.preprocessor_header().itemsize + 2
    scan = layouts.PREPROCESSOR_SCAN.itemsize + 6 * layouts.preprocessor_pixel().itemsize
    rows, n, _ = bytes_read(folder, monkeypatch, scans="-1")
    assert {r["scan"] for r in rows} == {19} and len(rows) == 18 and n == 3 * (head + scan)
    rows, n, left = bytes_read(folder, monkeypatch, [sw.EqualTo(("granule",), 1), sw.GreaterThan(("scan",), 16), sw.LessThanOrEqual(("scan",), 18), sw.EqualTo(("pixel",), 0)])
    assert {(r["granule"], r["scan"]) for r in rows} == {(1, 17), (1, 18)} and n == 3 * head + 2 * scan and len(left) == 1
    rows, n, _ = bytes_read(folder, monkeypatch, [sw.In(("scan",), (3, 5))])
    assert {r["scan"] for r in rows} == {3, 5} and n == 3 * (head + 3 * scan)


@pytest.mark.parametrize("most", [100, 997, 5000, 1 << 20])
def test_ranges_of_bytes_hold_every_scan_once(spark, pixels, folder, most):
    back = sw.read(spark, "preprocessor", folder, ["granule", "scan", "pixel", "latitude"], maxPartitionBytes=str(most))
    assert as_rows(back) == as_rows(pixels.select("granule", "scan", "pixel", "latitude"))


def test_filters_reach_the_source(spark, folder):
    df = sw.read(spark, "preprocessor", folder).where("granule = 2 and scan between 3 and 5 and pixel < 2").select("scan", "pixel")
    assert df.count() == 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("Filter") :] if "Filter" in plan else ""
    assert re.search(r"pixel#\d+ <", filters) and not re.search(r"(scan|granule)#\d+ [<>=]", filters)
    assert {r["scan"] for r in sw.read(spark, "preprocessor", folder, scans="-3:-1").select("scan").collect()} == {17, 18}


def test_gzip_cut_and_limited_files(spark, pixels, folder, tmp_path):
    content = open(f"{folder}/000002.pp", "rb").read()
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.pp.gz").write_bytes(gzip.compress(content))
    (tmp_path / "x/b.pp").write_bytes(content[:-5])
    (tmp_path / "x/c.pp").write_bytes(content[:50])
    n = {r["path"].rpartition("/")[2]: r["count"] for r in sw.read(spark, "preprocessor", str(tmp_path / "x")).groupBy("path").count().collect()}
    assert n == {"a.pp.gz": 120, "b.pp": 114}
    assert sw.read(spark, "preprocessor", str(tmp_path / "x/*.gz"), scans="-1").count() == 6
    sw.write_granules(sw.read(spark, "preprocessor", folder), "preprocessor", str(tmp_path / "y"), most_scans="4", compression="gzip")
    back = sw.read(spark, "preprocessor", str(tmp_path / "y"))
    assert as_rows(back.select("granule", "scan", "pixel", "latitude")) == as_rows(pixels.where("scan < 4").select("granule", "scan", "pixel", "latitude"))


def test_retrieval_variants(spark, pixels, tmp_path):
    day = F.array(*[F.lit(v).cast("smallint") for v in (2019, 3, 4, 5, 6)], F.col("scan").cast("smallint"), F.lit(0).cast("smallint"))
    df = pixels.select("granule", "scan", "pixel", "latitude", day.alias("scan_date"), F.col("latitude").alias("surface_precip"), F.transform(F.sequence(F.lit(0), F.lit(111)), lambda k: (k + F.col("scan")).cast("float")).alias("profiles"))
    for variant in ("plain", "profiles", "sensitivity"):
        path = str(tmp_path / variant)
        sw.write_granules(df, "retrieval", path, variant=variant, clusters="2", algorithm="TEST")
        assert [x.path.rpartition("/")[2] for x in store.listed(path)] == [f"2A.TEST.V0.20190304-S050600-E050619.{g:06}.BIN" for g in range(3)]
        back = sw.read(spark, "retrieval", path, variant=variant, clusters="2")
        columns = [c for c in df.columns if c in back.columns]
        assert ("profiles" in columns) == (variant == "profiles") and as_rows(back.select(*columns)) == as_rows(df.select(*columns))


def test_records_by_name(spark, tmp_path):
    """Bins are ruled out by their names; match-ups may be gzipped."""
    df = spark.range(60).select(F.format_string("gpm_%03d_%02d_%02d.bin", 250 + F.col("id") % 3 * 10, F.col("id") % 2 * 30, F.lit(7)).alias("file"), F.col("id").cast("int").alias("dataset_number"), (F.col("id") * 0.25).cast("float").alias("surface_precip"))
    path = str(tmp_path / "bins")
    sw.write_records(df, "apriori", path, ["dataset_number"], **{"header.sensor": "GMI"})
    back = sw.read(spark, "apriori", path, ["t2m_bin", "tcwv_bin", "surface_bin", "airmass_bin", "dataset_number", "surface_precip"])
    got = back.where("t2m_bin >= 260 and tcwv_bin = 30")
    assert {(r["t2m_bin"], r["tcwv_bin"], r["surface_bin"], r["airmass_bin"]) for r in got.collect()} == {(260, 30, 7, None), (270, 30, 7, None)} and got.count() == 20
    assert got.rdd.getNumPartitions() == 2  # of six files
    match = df.select(F.lit("GMI_1901.bin").alias("file"), F.col("surface_precip"), F.col("surface_precip").alias("latitude"), F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: k.cast("float")).alias("brightness_temperatures"))
    sw.write_records(match, "matchup", str(tmp_path / "m"), ["latitude"], compression="gzip")
    back = sw.read(spark, "matchup", str(tmp_path / "m/*.bin.gz"))
    assert back.agg(F.sum("surface_precip"), F.count("*")).first()[:] == (442.5, 60) and back.first()["brightness_temperatures"][3] == 3.0


def test_failures_leave_nothing(spark, pixels, tmp_path):
    path = str(tmp_path / "z")
    twice = pixels.unionByName(pixels.where("granule = 1 and scan = 2 and pixel = 3"))
    with pytest.raises(Exception, match="has a place twice"):
        sw.write_granules(twice, "preprocessor", path)
    with pytest.raises(Exception, match="written twice"):
        pixels.repartition(2, "pixel").sortWithinPartitions("granule").write.format("preprocessor").mode("append").save(path)
    assert store.listed(path) == [] and not list((tmp_path / "z").glob("_temporary*/*"))
    sw.write_granules(pixels, "preprocessor", path)
    with pytest.raises(Exception, match="written twice"):
        sw.write_granules(pixels, "preprocessor", path)
    sw.write_granules(pixels.where("granule = 1"), "preprocessor", path, "overwrite")
    assert len(store.listed(path)) == 1 and not list((tmp_path / "z").glob("_temporary*"))


def test_many_ranges_are_few_tasks(spark, pixels, folder):
    """Each scan is read once, however many ranges a task reads; a file's ranges that follow each other are one."""
    options = {"maxPartitionBytes": "100", "maxTasks": "4"}
    back = sw.read(spark, "preprocessor", folder, ["granule", "scan", "pixel", "latitude"], **options)
    assert back.rdd.getNumPartitions() <= 4 and as_rows(back) == as_rows(pixels.select("granule", "scan", "pixel", "latitude"))
    parts = [sw.Part(f"f{i}", a, a + 10, 30) for i in range(5) for a in (0, 10, 20)]
    assert len(sw.dealt(parts, 15)) == 15
    for most in (1, 2, 4, 7):
        tasks = sw.dealt(parts, most)
        assert len(tasks) <= most and sum(p.end - p.start for t in tasks for p in t.parts) == 150 and all(len({p.path for p in t.parts}) == len(t.parts) for t in tasks)
