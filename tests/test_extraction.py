"""Runs of an extraction: broken files are set aside, a later run takes what is missing."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import extraction
from orbitframe.sources import swathfiles as sw


@pytest.fixture
def files(spark, tmp_path):
    n = F.col("id").cast("int")
    df = spark.range(10 * 8 * 4).select((n % 10).alias("granule"), (n / 40).cast("int").alias("scan"), ((n / 10).cast("int") % 4).alias("pixel"), (n * 1.0).cast("float").alias("latitude"))
    path = str(tmp_path / "in")
    sw.write_granules(df, "preprocessor", path)
    return df, path


def test_broken_files_are_rows(spark, files, tmp_path):
    df, path = files
    whole = open(f"{path}/000003.pp", "rb").read()
    open(f"{path}/000003.pp", "wb").write(whole[:-50])
    out = str(tmp_path / "out")
    keep = lambda rows: rows.select("path", "granule", "latitude")
    said = {os.path.basename(r["path"]): r for r in extraction.extract(spark, path, "preprocessor", out, keep, maxPartitionBytes="700").collect()}
    assert len(said) == 10 and [k for k, r in said.items() if r["error"]] == ["000003.pp"] and "8 scans of 4 pixels promised" in said["000003.pp"]["error"]
    want = df.where("granule <> 3").select("granule", "latitude")
    assert sorted(extraction.results(spark, out).select("granule", "latitude").collect()) == sorted(want.collect())
    # mended, it alone is read again
    open(f"{path}/000003.pp", "wb").write(whole)
    again = extraction.extract(spark, path, "preprocessor", out, keep, maxPartitionBytes="700").collect()
    assert [(os.path.basename(r["path"]), r["n"], r["error"]) for r in again] == [("000003.pp", 32, None)]
    assert sorted(extraction.results(spark, out).select("granule", "latitude").collect()) == sorted(df.select("granule", "latitude").collect())
    assert extraction.extract(spark, path, "preprocessor", out, keep).collect() == []


def test_other_faults(spark, files, tmp_path):
    _, path = files
    content = open(f"{path}/000001.pp", "rb").read()
    open(f"{path}/000001.pp", "wb").write(b"short")
    os.remove(f"{path}/000002.pp")
    open(f"{path}/000002.pp.gz", "wb").write(gzip.compress(content)[:-20])
    out = str(tmp_path / "out")

    def picky(pdf):
        if pdf.granule.iloc[0] == 5:
            raise KeyError("no such field")
        return pdf.groupby("granule", as_index=False).latitude.sum()

    said = extraction.extract(spark, path, "preprocessor", out, lambda rows: extraction.isolated(rows, "path", picky, "granule int, latitude double"))
    errors = {os.path.basename(r["path"])[:6]: r["error"] for r in said.collect() if r["error"]}
    assert set(errors) == {"000001", "000002", "000005"} and "header" in errors["000001"] and "KeyError" in errors["000005"]
    assert {r["granule"] for r in extraction.results(spark, out).collect()} == {0, 3, 4, 6, 7, 8, 9}
    with pytest.raises(Exception, match="EOFError"):
        sw.read(spark, "preprocessor", path).where("granule >= 0").count()


def test_a_run_without_a_record_does_not_count(spark, files, tmp_path):
    df, path = files
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="no_such_column"):
        extraction.extract(spark, path, "preprocessor", out, lambda rows: rows.select("path", "no_such_column"))
    assert extraction.record(spark, out).count() == 0
    assert len(extraction.extract(spark, path, "preprocessor", out, lambda rows: rows.select("path", "latitude")).collect()) == 10
