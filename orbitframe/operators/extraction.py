"""Extraction of files into a table, by runs: a file that fails is a row of the run's record, and a later run takes what is missing.

A run reads each file once into a staged table, sets aside those with an error, and gives the rows of the others to a transformation. Its results
stand in a folder of their own and count only when its record is written, so a run that dies leaves nothing that is read, and its files are taken
again. The record has a row a file; names of files, listed by the driver anyway, are all that passes through it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.sources import store, swathfiles

RECORD = "path string, run string, n long, error string"


def isolated(df: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """function(pandas frame) of each file's rows, with columns `key` and `error`: a file for which it raises gives one row with the error. A file has
    a bounded size."""

    def run(pdf):
        import pandas as pd

        name = pdf[key].iloc[0]
        try:
            return function(pdf).assign(**{key: name, "error": None})
        except Exception as e:
            return pd.DataFrame({key: [name], "error": [f"{type(e).__name__}: {e}"[:500]]}).reindex(columns=names)

    names = [x.split()[0] for x in schema.split(",")] + [key, "error"]
    return df.groupBy(key).applyInPandas(run, f"{schema}, {key} string, error string")


def record(spark: SparkSession, out: str) -> DataFrame:
    """(path, run, n, error) of every file of every run at `out`."""
    system, path = store.resolve(out)
    if system.get_file_info(f"{path}/record").type != fs.FileType.Directory:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(f"{out}/record")


def results(spark: SparkSession, out: str) -> DataFrame:
    """What runs with a record have found."""
    runs = [r["run"] for r in record(spark, out).where("error is null").select("run").distinct().collect()]
    return spark.read.parquet(*(f"{out}/results/run={r}" for r in runs))


def extract(spark: SparkSession, source: str, kind: str, out: str, transform: Callable[[DataFrame], DataFrame], columns: list[str] | None = None, **options) -> DataFrame:
    """Files of a format at `source` that no run at `out` has extracted, through `transform`, which keeps `path` and may set `error` on rows of files that
    it cannot use. Returns the run's record."""
    run = uuid.uuid4().hex
    done = [r["path"] for r in record(spark, out).where("error is null").select("path").collect()]
    skip = store.workspace(spark, "skip")
    system, path = store.resolve(skip)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as file:
        file.write("\n".join(done).encode())
    names = None if columns is None else ["path", *columns, "error"]
    read = swathfiles.read(spark, kind, source, names, errors="rows", skip=skip, **options)
    staged = store.workspace(spark, "extract")
    read.write.parquet(staged)
    rows = spark.read.schema(read.schema).parquet(staged)
    failed = rows.where("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    good = rows.where("error is null").drop("error").join(failed, "path", "left_anti")
    found = transform(good)
    if "error" in found.columns:
        tried = store.workspace(spark, "tried")
        found.write.parquet(tried)
        found = spark.read.schema(found.schema).parquet(tried)
        worse = found.where("error is not null").groupBy("path").agg(F.min("error").alias("error"))
        found, failed = found.where("error is null").drop("error").join(worse, "path", "left_anti"), failed.unionByName(worse)
    found.write.parquet(f"{out}/results/run={run}")
    counts = spark.read.schema(found.schema).parquet(f"{out}/results/run={run}").groupBy("path").agg(F.count("*").alias("n"))
    seen = rows.select("path").distinct().join(counts, "path", "left").join(failed, "path", "left")
    seen = seen.select("path", F.lit(run).alias("run"), F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("n"), "error")
    seen.write.mode("append").parquet(f"{out}/record")
    return record(spark, out).where(F.col("run") == run)
