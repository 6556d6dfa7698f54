"""Flat binary rasters: spark.read.format("raster") gives a row a cell, and a writer packs cells into files.

A raster file is rows by columns of one number type, from north to south, without a header; several of one shape (months) are read together. Files
are dealt in ranges of bytes; of more than `maxTasks` ranges (512), a task reads several. Options: path, rows, columns, type (i1, i2, i4, f4),
maxPartitionBytes, maxTasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from orbitframe.functions import surface
from orbitframe.sources import store
from orbitframe.sources.swathfiles import PIECE, TASKS, Part, Parts, dealt

SCHEMA = "file string, row int, col int, value double"


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.shape, self.kind = options["path"], (int(options["rows"]), int(options["columns"])), np.dtype("<" + options["type"])
        self.most = int(options.get("maxpartitionbytes", 64 << 20)) // self.kind.itemsize * self.kind.itemsize or self.kind.itemsize
        self.tasks = int(options.get("maxtasks", TASKS))

    def partitions(self) -> Sequence[Parts]:
        size, out = self.shape[0] * self.shape[1] * self.kind.itemsize, []
        for found in store.listed(self.path):
            if found.size != size:
                raise ValueError(f"{found.path} has {found.size} bytes, {self.shape} cells of {self.kind.itemsize} have {size}")
            out += [Part(found.path, a, min(a + self.most, size), size) for a in range(0, size, self.most)]
        return dealt(out, self.tasks)

    def read(self, task: Parts | None) -> Iterator[pa.RecordBatch]:
        for part in task.parts if task is not None else []:  # None is what Spark asks for when there is no part
            yield from self._one(part)

    def _one(self, part: Part) -> Iterator[pa.RecordBatch]:
        with store.resolve(self.path)[0].open_input_file(part.path) as file:
            file.seek(part.start)
            for a in range(part.start, part.end, PIECE):
                values = np.frombuffer(file.read(min(PIECE, part.end - a)), self.kind)
                at = a // self.kind.itemsize + np.arange(len(values))
                names = pa.array([part.path.rpartition("/")[2]]).take(pa.array(np.zeros(len(values), "i4")))
                yield pa.RecordBatch.from_arrays([names, pa.array((at // self.shape[1]).astype("i4")), pa.array((at % self.shape[1]).astype("i4")), pa.array(values.astype("f8"))], names=["file", "row", "col", "value"])


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(dict(self.options))


def read(spark: SparkSession, path: str, rows: int, columns: int, kind: str, **options) -> DataFrame:
    """(file, row, col, value) of every cell."""
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster").options(rows=rows, columns=columns, type=kind, **options).load(path)


def write(cells: DataFrame, path: str, rows: int, columns: int, kind: str, missing: float = 0, files: Sequence[str] = ()) -> None:
    """Cells (file, row, col, value) as one file for each name, and for each of `files`, which may have no cell; cells without a row are `missing`. A
    band of rows is packed by a task, and one task a file puts the bands together, a band at a time; files get their names when all are done."""
    dtype, band = np.dtype("<" + kind), max(1, PIECE // (columns * np.dtype("<" + kind).itemsize))
    folder = f"_temporary-{uuid.uuid4().hex}"

    def pack(pdf):
        import pandas as pd

        k = int(pdf.band.iloc[0])
        field = np.full((min(band, rows - k * band), columns), missing, dtype)
        field[pdf.row - k * band, pdf.col] = pdf.value
        system, inner = store.resolve(path)
        system.create_dir(f"{inner}/{folder}", recursive=True)
        name = f"{inner}/{folder}/{uuid.uuid4().hex}"
        with system.open_output_stream(name) as out:
            out.write(field.tobytes())
        return pd.DataFrame({"file": [pdf.file.iloc[0]], "band": [k], "part": [name]})

    def join(pdf):
        import pandas as pd

        there = pdf.dropna(subset="part")
        own = dict(zip(there.band, there.part, strict=True))
        system, inner = store.resolve(path)
        system.create_dir(f"{inner}/{folder}", recursive=True)
        done = f"{inner}/{folder}/{uuid.uuid4().hex}"
        with system.open_output_stream(done) as out:
            for k in range(-(-rows // band)):
                if k in own:
                    with system.open_input_file(own[k]) as part:
                        out.write(part.read())
                else:
                    out.write(np.full((min(band, rows - k * band), columns), missing, dtype).tobytes())
        return pd.DataFrame({"file": [pdf.file.iloc[0]], "part": [done]})

    parts = cells.withColumn("band", F.expr(f"cast(floor(row / {band}) as int)")).groupBy("file", "band").applyInPandas(pack, "file string, band int, part string")
    if files:
        named = cells.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, files))).alias("file"))
        parts = parts.unionByName(named.select("file", F.lit(None).cast("int").alias("band"), F.lit(None).cast("string").alias("part")))
    system, inner = store.resolve(path)
    whole = parts.groupBy("file").applyInPandas(join, "file string, part string").collect()  # a row a file
    for r in whole:
        system.move(r["part"], f"{inner}/{r['file']}")
    if whole:
        system.delete_dir(f"{inner}/{folder}")


def scaled(c: Column, ratio: float, n: int) -> Column:
    """Index in a grid of n whose cells are 1 / ratio as wide."""
    return F.least(F.floor(c * ratio), F.lit(n - 1)).cast("int")


def surface_map(land: DataFrame, snow: DataFrame, emissivity: DataFrame, mountain: DataFrame, shapes: dict[str, tuple[int, int]], month: int) -> DataFrame:
    """(row, col, lat, lon, surface_type) on the grid of land shares (row, col, value): snow cover, twelve emissivity classes (row, col, month, value) and
    mountains have grids of their own, met by scaled indices in equi-joins; rows go from north to south."""
    rows, columns = shapes["land"]

    def on(name: str, cells: DataFrame) -> DataFrame:
        return cells.select(F.col("row").alias(f"{name}_row"), F.col("col").alias(f"{name}_col"), F.col("value").alias(name))

    months = emissivity.groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("month", F.col("value").cast("int").alias("v")))).alias("m"))
    months = months.select("row", "col", F.transform("m", lambda e: e["v"]).alias("value"))  # twelve a cell
    out = land.select("row", "col", F.col("value").cast("int").alias("land"))
    for name, cells in (("snow", snow), ("emissivity", months), ("mountain", mountain)):
        ratio, own = shapes[name][1] / columns, shapes[name]
        out = out.withColumns({f"{name}_row": scaled(F.col("row"), ratio, own[0]), f"{name}_col": scaled(F.col("col"), ratio, own[1])})
        out = out.join(on(name, cells), [f"{name}_row", f"{name}_col"], "left").drop(f"{name}_row", f"{name}_col")
    lat, lon = 90 - (F.col("row") + 1) * (180 / rows), -180 + F.col("col") * (360 / columns)
    base = surface.classify(F.col("land"), F.col("snow").cast("int"), F.col("emissivity"), F.lit(month))
    whole = surface.mountains(surface.ice_sheets(base, lat, lon), F.coalesce("mountain", F.lit(0.0)))
    return out.select("row", "col", lat.alias("lat"), lon.alias("lon"), whole.cast("int").alias("surface_type"))
