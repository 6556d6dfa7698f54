"""Fixed-record binary files: a header and then records of one layout, read and written by tasks, one file a task at least."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"S": "binary", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "f4": "float", "f8": "double"}


def schema_of(layout: np.dtype) -> str:
    """The columns of a layout: numbers, and arrays of them."""
    out = []
    for name in layout.names:
        base, shape = layout[name].base, layout[name].shape
        kind = KINDS["S" if base.kind == "S" else base.str[1:]]
        out.append(f"{name} {'array<' * len(shape)}{kind}{'>' * len(shape)}")
    return ", ".join(out)


def read(spark: SparkSession, path: str, layout: np.dtype, header: int = 0) -> DataFrame:
    """(file, record, columns of the layout) of every record below path; what is cut off at a file's end is left out."""
    return decode(spark.read.format("binaryFile").load(path).select("path", "content"), layout, header)


def decode(files: DataFrame, layout: np.dtype, header: int = 0) -> DataFrame:
    """The same of the files (path, content). Files are cut into runs of records of some KB before Python gets them, so that what a Python process
    holds depends on neither their size nor their number."""
    size, per = layout.itemsize, max(1, 2048 // layout.itemsize)
    n = F.floor((F.length("content") - header) / size)
    first = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(per).cast("long")))).alias("record")
    cut = files.select("path", "content", n.alias("n"), first)
    start = F.lit(header + 1) + F.col("record") * size
    cut = cut.select("path", "record", F.substring("content", start.cast("int"), (F.least(F.lit(per), F.col("n") - F.col("record")) * size).cast("int")).alias("content"))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = part.content.str.len().to_numpy(dtype=int) // size
            rows = np.frombuffer(b"".join(part.content), layout)
            names = np.repeat(part.path.to_numpy(), n)
            number = np.arange(len(rows)) + np.repeat(part.record.to_numpy() - (np.cumsum(n) - n), n)
            for s in range(0, len(rows), 2_000):
                piece = rows[s : s + 2_000]
                columns = {k: list(piece[k].tolist()) if layout[k].shape else piece[k].astype(layout[k].newbyteorder("=")) for k in layout.names}
                yield pd.DataFrame({"file": names[s : s + 2_000], "record": number[s : s + 2_000], **columns})

    return cut.mapInPandas(parse, f"file string, record bigint, {schema_of(layout)}")


def encode(df: DataFrame, key: str, order: str, layout: np.dtype, header: bytes = b"") -> DataFrame:
    """(key, content): one file's bytes for each key; a granule has a bounded size. Fields without a column are zero."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = np.zeros(len(pdf), layout)
        for k in layout.names:
            if k in pdf:
                rows[k] = np.array([np.stack(v) for v in pdf[k]] if len(layout[k].shape) > 1 else pdf[k].tolist())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [header + rows.tobytes()]})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandas(pack, f"{key} {kind}, content binary")


def null_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sentinels at or below -999 and NaN become null."""
    from orbitframe.functions.clean import null_if_missing

    return df.withColumns({c: null_if_missing(F.col(c)) for c in columns})
