"""Granule files: an orbit header, then scans of a scan header and a fixed number of pixel records; other whole-file formats.

Files are rows (path, content), from `files` or from `pack`; a granule has a bounded size (some 100 MB). Python parses scans, not whole files."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.sources import layouts
from orbitframe.sources.records import schema_of

# File names of each format.
FORMATS = {"retrieval": r"\.bin(\.gz)?$", "preprocessor": r"\.pp$", "l1c": r"(^|/)1C[^/]*$", "simulator": r"\.sim$", "a-priori": r"(^|/)gpm[^/]*\.bin$", "netcdf": r"\.nc(\.gz|\.lz4)?$"}


def format_of(path: str) -> str:
    """The format that a file name stands for; names of a-priori files before others that end alike."""
    for kind in ("a-priori", "preprocessor", "l1c", "simulator", "netcdf", "retrieval"):
        if re.search(FORMATS[kind], path):
            return kind
    raise ValueError(f"no known format: {path}")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _plain(content: Column) -> Column:
    """Gzipped files as they were; only these go through Python."""
    whole = F.substring(content, 1, 2) == F.lit(b"\x1f\x8b")
    gunzip = F.udf(lambda v: None if v is None else gzip.decompress(bytes(v)), "binary")
    return F.when(whole, gunzip(F.when(whole, content))).otherwise(content)


def _number(content: Column, kind: np.dtype, name: str) -> Column:
    """A whole number of a header, of its bytes in little-endian order."""
    (base, at), total = kind.fields[name][:2], F.lit(0).cast("long")
    for k in range(base.itemsize):
        total = total + F.conv(F.hex(F.substring(content, at + k + 1, 1)), 16, 10).cast("long") * (1 << 8 * k)
    return F.when(total >= 1 << (8 * base.itemsize - 1), total - (1 << 8 * base.itemsize)).otherwise(total).cast("int")


def _column(values: np.ndarray):
    return values.tolist() if values.ndim > 1 else values.astype(values.dtype.newbyteorder("="))


def read_scans(source: DataFrame, header: np.dtype, scan: np.dtype, pixel: np.dtype, skip: int = 0, scans: Column | None = None, gzipped: bool = True) -> DataFrame:
    """(path, granule, scan, pixel, scan columns, pixel columns) of granule files, whole or gzipped; `skip` bytes follow the header. `scans`
    filters by scan number before any pixel is read. Files are cut into scans before Python gets them, so that what a Python process holds depends
    on neither their size nor their number. `gzipped` false: no file is."""
    size, base = f"path string, granule int, scan int, pixel int, {schema_of(scan)}, {schema_of(pixel)}", header.itemsize + skip
    content = F.col("content")
    head = source.select("path", (_plain(content) if gzipped else content).alias("content")).where(F.length("content") >= base)
    head = head.select("path", "content", *(_number(content, header, k).alias(a) for k, a in (("granule_number", "granule"), ("number_of_scans", "n"), ("number_of_pixels", "m"))))
    each = F.lit(scan.itemsize) + F.col("m") * pixel.itemsize
    whole = F.least(F.col("n"), F.floor((F.length("content") - base) / each).cast("int"))
    cut = head.select("path", "granule", "m", "content", F.explode(F.when((whole > 0) & (F.col("m") > 0), F.sequence(F.lit(0), whole - 1))).alias("scan"))
    cut = cut if scans is None else cut.where(scans)
    cut = cut.select("path", "granule", "m", "scan", F.substring("content", F.lit(base + 1) + F.col("scan") * each, each).alias("content"))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for m, own in part.groupby("m", sort=False):
                kind = np.dtype([("scan", scan), ("pixels", pixel, (m,))])
                for s in range(0, len(own), 64):
                    some = own.iloc[s : s + 64]
                    piece = np.frombuffer(b"".join(some.content), kind)
                    each, flat = np.repeat(piece["scan"], m), piece["pixels"].ravel()
                    yield pd.DataFrame(
                        {**{k: np.repeat(some[k].to_numpy(), m) for k in ("path", "granule", "scan")}, "pixel": np.tile(np.arange(m, dtype="i4"), len(piece))}
                        | {k: _column(each[k]) for k in scan.names} | {k: _column(flat[k]) for k in pixel.names}
                    )

    return cut.mapInPandas(parse, size)


def pack(df: DataFrame, header: np.dtype, scan: np.dtype, pixel: np.dtype, fixed: dict | None = None, skip: bytes = b"", most_scans: int | None = None) -> DataFrame:
    """(path, content) of one file for each granule of (granule, scan, pixel, columns); places without a row are zero. `fixed` are header values;
    `most_scans` writes the first scans alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        granule = int(pdf.granule.iloc[0])
        if most_scans is not None:
            pdf = pdf[pdf.scan < most_scans]
        n, m = int(pdf.scan.max()) + 1, int(pdf.pixel.max()) + 1
        head, rows = np.zeros(1, header), np.zeros(n, np.dtype([("scan", scan), ("pixels", pixel, (m,))]))
        for k, v in {"granule_number": granule, "number_of_scans": n, "number_of_pixels": m, **(fixed or {})}.items():
            head[k] = v
        at = (pdf.scan.to_numpy(), pdf.pixel.to_numpy())
        for k in scan.names:
            if k in pdf:
                rows["scan"][k][at[0]] = np.array(pdf[k].tolist())
        for k in pixel.names:
            if k in pdf:
                rows["pixels"][k][at] = np.array(pdf[k].tolist())
        return pd.DataFrame({"path": [f"{granule:06}"], "content": [head.tobytes() + skip + rows.tobytes()]})

    return df.groupBy("granule").applyInPandas(run, "path string, content binary")


def read_cdfs(source: DataFrame) -> DataFrame:
    """(path, surface, channel, angle, tcwv, tb, cdf, n) of the cells that have a count, of files of all CDFs and histograms."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part.path, part.content, strict=True):
                surfaces, channels, angles, w0, w1, t0, t1 = np.frombuffer(content, "<i4", 7).tolist()
                shape = (surfaces, channels, angles, w1 - w0 + 1, t1 - t0 + 1)
                size = int(np.prod(shape))
                cdf = np.frombuffer(content, "<f4", size, 28).reshape(shape, order="F")
                n = np.frombuffer(content, "<i8", size, 28 + 4 * size).reshape(shape, order="F")
                at = np.nonzero(n)
                for s in range(0, len(at[0]), 100_000):
                    i = tuple(a[s : s + 100_000] for a in at)
                    yield pd.DataFrame({"path": path, "surface": i[0], "channel": i[1], "angle": i[2], "tcwv": i[3] + w0, "tb": i[4] + t0, "cdf": cdf[i].astype(float), "n": n[i].astype("i8")})

    return source.mapInPandas(parse, "path string, surface int, channel int, angle int, tcwv int, tb int, cdf double, n bigint")


def write_cdfs(df: DataFrame, shape: tuple[int, int, int], tcwv: tuple[int, int], tb: tuple[int, int]) -> DataFrame:
    """(path, content) of one file of (surface, channel, angle, tcwv, tb, cdf, n); its size is set by the shape and the bounds alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = (*shape, tcwv[1] - tcwv[0] + 1, tb[1] - tb[0] + 1)
        cdf, n = np.zeros(whole, "<f4", order="F"), np.zeros(whole, "<i8", order="F")
        at = (pdf.surface, pdf.channel, pdf.angle, pdf.tcwv - tcwv[0], pdf.tb - tb[0])
        cdf[at], n[at] = pdf.cdf, pdf.n
        head = np.array([*shape, *tcwv, *tb], "<i4").tobytes()
        return pd.DataFrame({"path": ["cdf"], "content": [head + cdf.tobytes(order="F") + n.tobytes(order="F")]})

    return df.withColumn("file", F.lit(0)).groupBy("file").applyInPandas(run, "path string, content binary")


def ascii_grids(lines: DataFrame) -> DataFrame:
    """(path, row, col, lat, lon, value) of text grids, from (path, line_no, line): six header lines (columns, rows, west, south, step, missing), then
    rows from north to south; negative values are null."""
    parts = F.split(F.trim("line"), r"\s+")
    head = lines.where("line_no < 6").groupBy("path").pivot("line_no", list(range(6))).agg(F.first(F.element_at(parts, 2).cast("double")))
    head = head.select("path", F.col("1").alias("n_rows"), F.col("2").alias("west"), F.col("3").alias("south"), F.col("4").alias("step"))
    cells = lines.where("line_no >= 6").select("path", (F.col("line_no") - 6).cast("int").alias("row"), F.posexplode(parts).alias("col", "v"))
    v = F.col("v").cast("double")
    lat = F.col("south") + (F.col("n_rows") - 1 - F.col("row")) * F.col("step")
    return cells.join(head, "path").select("path", "row", "col", lat.alias("lat"), (F.col("west") + F.col("col") * F.col("step")).alias("lon"), F.when(v >= 0, v).alias("value"))


def retrieval_header() -> np.dtype:
    return layouts.layout(
        """satellite S12, sensor S12, preprocessor S12, algorithm S12, radiometer_file S128, profile_database_file S128, creation_date i2 6, granule_start_date i2 6,
        granule_end_date i2 6, granule_number i4, number_of_scans i2, number_of_pixels i2, profile_struct i1, spares S51"""
    )


def profile_info(n_species: int = 5, temperatures: int = 12, n_profiles: int = 80) -> np.dtype:
    """What follows the header of a retrieval file: the clusters' profiles, by species, temperature, layer and cluster."""
    size = n_species * temperatures * layouts.LAYERS * n_profiles
    return layouts.layout(f"n_species i1, n_temps i1, n_layers i1, n_profiles i1, species_description S20 {n_species}, height_top_layers f4 {layouts.LAYERS}, temperature f4 {temperatures}, profiles f4 {size}")
