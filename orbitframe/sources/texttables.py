"""Text tables of numbers, one line a row: a whole number of three places and values of six places with two digits, below lines that begin with #."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, VALUE = "%3d", "%6.2f"


def lines(table: DataFrame, key: str, values: str, n: int) -> DataFrame:
    """(key, line) of rows with an array of n values."""
    return table.select(key, F.format_string(" ".join([KEY, *[VALUE] * n]), key, *(F.get(values, F.lit(i)) for i in range(n))).alias("line"))


def write(table: DataFrame, path: str, key: str, values: str, n: int, header: str = "", mode: str = "error") -> None:
    """The rows in the order of their key as text files whose names keep that order; the header leads the first."""
    heads = [f"# {h}" for h in header.split("\n")] if header else []
    body = lines(table.where(F.col(key).isNotNull()), key, values, n).select(F.lit(1).alias("__part"), F.col(key).cast("long").alias("__at"), "line")
    spark = table.sparkSession
    head = spark.createDataFrame([(0, i, h) for i, h in enumerate(heads)], "__part int, __at long, line string")
    head.unionByName(body).orderBy("__part", "__at").select("line").write.mode(mode).text(path)


def read(spark: SparkSession, path: str, key: str, values: str) -> DataFrame:
    """(key, values) of the lines that are not comments; what is no number is null."""
    line = F.rtrim(F.regexp_replace("value", "#.*", ""))
    fields = F.split(F.trim(line), r"\s+")
    found = spark.read.text(path).where(line != "")
    return found.select(F.get(fields, F.lit(0)).cast("int").alias(key), F.transform(F.slice(fields, 2, 1000), lambda v: v.try_cast("double")).alias(values))
