"""Corpus pipeline: documents to a training mix, each stage on all that the one before kept.

Toxic documents go, one document of each near-duplicate class stays, passages that an earlier document holds are cut, documents with
benchmark items go, and sources are mixed to target weights (a document may then stand twice). Columns stay those of documents.

Defined cases: a null text is empty to every stage; it and an empty text are kept, but for the classifier's say, and stand once in the mix. Rows of one id
are one document to near duplicates (one row stays) and are judged each by itself elsewhere. Rows with a null id pass near duplicates and
decontamination as they are; the other stages treat them like any. An empty table stays empty. Other columns, whatever their names, are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm.common import stage, table
from orbitframe.llm.decontaminate import clean
from orbitframe.llm.mixing import sample
from orbitframe.llm.neardup import keep_one
from orbitframe.llm.substrings import remove_repeats
from orbitframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

ORACLE_SQL = None  # a trained classifier is not an SQL expression


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
