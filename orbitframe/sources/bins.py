"""A-priori samples as a table partitioned by bin, so that a range of bins, or a list of them, reads its own files alone.

Bins are whole degrees of two-metre temperature and whole millimetres of water vapour, as in the names of bin files. A folder holds STEP by STEP
bins, as folders of single ones would be far more than files are worth; inside, rows are sorted by bin and surface, and the statistics of row
groups rule out what lies beside the range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.operators import sequence

T2M_STEP, TCWV_STEP = 10, 10


def write(samples: DataFrame, path: str, mode: str = "error") -> None:
    """Samples (t2m_bin, tcwv_bin, surface_type, ...) as a table at path. Folders get files of even size: a crowded one is split over tasks."""
    cells = {"t2m_cell": F.expr(f"cast(floor(t2m_bin / {T2M_STEP}) as int)"), "tcwv_cell": F.expr(f"cast(floor(tcwv_bin / {TCWV_STEP}) as int)")}
    dealt = samples.withColumns(cells).hint("rebalance", "t2m_cell", "tcwv_cell")
    sorted_ = dealt.sortWithinPartitions("t2m_cell", "tcwv_cell", "t2m_bin", "tcwv_bin", "surface_type")
    sorted_.write.partitionBy("t2m_cell", "tcwv_cell").mode(mode).parquet(path)


def read(spark: SparkSession, path: str, t2m: tuple[int, int] = (227, 307), tcwv: tuple[int, int] = (0, 76)) -> DataFrame:
    """The samples whose bins lie in both ranges, ends included."""
    cells = F.col("t2m_cell").between(t2m[0] // T2M_STEP, t2m[1] // T2M_STEP) & F.col("tcwv_cell").between(tcwv[0] // TCWV_STEP, tcwv[1] // TCWV_STEP)
    inside = F.col("t2m_bin").between(*t2m) & F.col("tcwv_bin").between(*tcwv)
    return spark.read.parquet(path).where(cells & inside).drop("t2m_cell", "tcwv_cell")


def read_listed(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The samples of the bins that a table (t2m_bin, tcwv_bin) lists; where it is small, its values prune the folders when the query runs."""
    keys = wanted.select("t2m_bin", "tcwv_bin").distinct()
    cells = keys.withColumns({"t2m_cell": F.expr(f"cast(floor(t2m_bin / {T2M_STEP}) as int)"), "tcwv_cell": F.expr(f"cast(floor(tcwv_bin / {TCWV_STEP}) as int)")})
    return spark.read.parquet(path).join(cells, ["t2m_cell", "tcwv_cell", "t2m_bin", "tcwv_bin"]).drop("t2m_cell", "tcwv_cell")


def fraction(samples: DataFrame, key: str, start: float, end: float) -> DataFrame:
    """From floor(start * n) to floor(end * n) of each bin and surface, in its fixed shuffle."""
    return sequence.fraction(samples, ["t2m_bin", "tcwv_bin", "surface_type"], key, start, end)
