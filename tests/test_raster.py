"""Gaps filled in tiles as in the whole raster."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

from orbitframe.operators import raster
from orbitframe.plans import registry
from orbitframe.sources import rasters


@pytest.mark.parametrize("passes, tile", [(raster.diagonal(3), 8), (raster.around(2), 5), (raster.diagonal(), 64)])
def test_tiles_fill_like_the_whole(spark, passes, tile):
    r = np.random.default_rng(tile)
    field = np.where(r.random((37, 29)) < 0.08, r.integers(1, 9, (37, 29)).astype(float), np.nan)
    rows = [(0, i - 5, j + 3, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(field)]
    got = {(q["y"], q["x"]): q["v"] for q in raster.fill(spark.createDataFrame(rows, "g int, y int, x int, v double"), ["g"], "y", "x", "v", passes, tile).collect()}
    want = raster.fill_array(field, passes)
    assert len(got) == field.size
    for (i, j), v in np.ndenumerate(want):
        assert got[i - 5, j + 3] == (None if np.isnan(v) else v)


def test_fill_by_hand():
    field = np.full((5, 5), np.nan)
    field[4, 4], field[0, 4] = 1, 2
    one = raster.fill_array(field, raster.diagonal(1))
    assert one[3, 3] == 1 and one[1, 3] == 2 and np.isnan(one[2, 0]) and np.isnan(one[2, 2])  # (1, 3) was filled in the same pass
    full = raster.fill_array(field, raster.around(1))
    assert full[3, 3] == full[3, 4] == full[4, 3] == 1 and full[0, 3] == full[1, 3] == full[1, 4] == 2 and np.isnan(full[2, 2])


def test_raster_files_round_trip(spark, tmp_path, monkeypatch):
    """Cells to files of bands and back, in ranges of bytes; absent cells are the missing value."""
    monkeypatch.setattr(rasters, "PIECE", 100)
    cells = spark.range(2 * 40 * 30).where("id % 7 <> 0").select(F.format_string("m%d", F.col("id") % 2).alias("file"), (F.col("id") / 60).cast("int").alias("row"), ((F.col("id") / 2).cast("int") % 30).alias("col"), (F.col("id") % 100 - 50).cast("double").alias("value"))
    rasters.write(cells, str(tmp_path / "r"), 40, 30, "i2", -99)
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["m0", "m1"] and (tmp_path / "r/m0").stat().st_size == 2 * 40 * 30
    for most in ("7", "333", "100000"):
        back = rasters.read(spark, str(tmp_path / "r"), 40, 30, "i2", maxPartitionBytes=most)
        assert back.count() == 2400 and sorted(back.where("value <> -99").collect()) == sorted(cells.collect())
    with pytest.raises(Exception, match="has 2400 bytes"):
        rasters.read(spark, str(tmp_path / "r"), 40, 30, "i1").count()


def test_ranges_of_rasters_are_partitions(spark, tmp_path):
    """Spark takes what the reader deals out, and each cell is read once, however many ranges a task reads."""
    for k in range(5):
        (np.arange(40 * 30) * (k + 1)).astype("<i4").tofile(tmp_path / f"m{k}")
    want = sorted((f"m{k}", i // 30, i % 30, float(i * (k + 1))) for k in range(5) for i in range(40 * 30))
    for most, tasks in (("512", 75), ("4", 4), ("1", 1)):
        options = {"path": str(tmp_path), "rows": "40", "columns": "30", "type": "i4", "maxpartitionbytes": "333", "maxtasks": most}
        dealt = rasters.RasterReader(options).partitions()
        assert len(dealt) == tasks and all(isinstance(p, InputPartition) for p in dealt) and sum(p.end - p.start for t in dealt for p in t.parts) == 5 * 4800
        back = rasters.read(spark, str(tmp_path), 40, 30, "i4", maxPartitionBytes="333", maxTasks=most)
        assert back.rdd.getNumPartitions() == tasks and sorted(map(tuple, back.collect())) == want
    (tmp_path / "none").mkdir()
    assert rasters.read(spark, str(tmp_path / "none"), 40, 30, "i4").count() == 0


@pytest.mark.parametrize("events", ["WHERE false", "WHERE event_id % 50 = 3", "UNION ALL SELECT NULL, ts, user_id, event_type, value, props FROM {t} UNION ALL SELECT -event_id, ts, user_id, event_type, value, props FROM {t}"])
def test_surface_map_of_odd_tables(spark, tmp_path, events):
    """Without a sample all rasters hold missing values; samples without a place, or beyond the grid, are in no cell, as in SQL."""
    table, name = "'/root/testdata/sf0.001/events.parquet'", "s17_surface_map"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM {table} {events.format(t=table)}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(f"SELECT sample_id, surface_type FROM ({registry.oracle_sql()[name]})").fetchall())
    got = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).select("sample_id", "surface_type").collect()))
    assert len(got) == 16200 and got == want


def test_few_copies_of_a_cell(spark):
    """A halo of 180 cells around tiles of 16 sends no cell to tiles that have none of their own; two rasters of the same places stay apart."""
    r = np.random.default_rng(3)
    fields = [np.where(r.random((40, 25)) < 0.1, r.integers(1, 9, (40, 25)).astype(float), np.nan) for _ in range(2)]
    rows = [(g, i, j, None if np.isnan(v) else float(v)) for g, f in enumerate(fields) for (i, j), v in np.ndenumerate(f)]
    out = raster.fill(spark.createDataFrame(rows, "g int, y int, x int, v double"), ["g"], "y", "x", "v", raster.diagonal(), 16)
    got = {(q["g"], q["y"], q["x"]): q["v"] for q in out.collect()}
    for g, f in enumerate(fields):
        for (i, j), v in np.ndenumerate(raster.fill_array(f, raster.diagonal())):
            assert got[g, i, j] == (None if np.isnan(v) else v)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(got) == 2000 and "LeftSemi" in plan
