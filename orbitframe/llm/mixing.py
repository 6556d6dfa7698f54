"""Mixing of sources to target weights by hash-threshold histograms.

A source's target is first met by whole copies of the source; what is then missing is filled with the documents of least hash (the first 60
bits of the md5 of the id). The threshold comes from histograms: words are summed by source and hash bucket, running sums find the bucket in
which the budget is used up, and only that bucket is split into finer buckets, four times by 2^15. So nothing is sorted, a histogram never
has more than 2^15 rows a source, and every sum is combined before it is shuffled. The document on the boundary is taken if more than half
of it still fits. The thresholds, one row a source, are joined to the documents by source.

Weights go by the rank of the source's name (code points, null last). Targets share `budget` times all words by weight and stop at
`most` times the source's words; the excess is shared again by weight until no target is above.

Defined cases: a null text has no words; sources without words have target 0; documents without words take 0; rows of one id in one source
have one hash and are taken or left together; a null id hashes as the empty text; an empty table gives an empty mix; other columns are
ignored (sample carries them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.llm.common import free, stage, table

LEVELS, BITS, MOST_SOURCES, SALTS = 4, 15, 20_000, 32


def size_of(text: Column) -> Column:
    """Number of words: a word starts where something other than a space follows a space or the start."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of each row (source, source_size)."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))  # one row a source
    rank = (F.row_number().over(order) - 1) % len(weights)
    now = stage(sizes.select("source", "source_size", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), rank + 1).alias("weight"), F.lit(False).alias("full")))
    everything = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full, free, count = now.agg(F.sum(F.when(F.col("full"), most * F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight"))), F.count_if("full")).first()
        unit = (budget * everything - (full or 0)) / free if free else 0.0
        over = F.col("full") | (F.lit(unit) * F.col("weight") >= most * F.col("source_size"))
        if now.where(over).count() == count:
            return now.select("source", "source_size", F.when(F.col("full"), most * F.col("source_size")).otherwise(F.lit(unit) * F.col("weight")).alias("target"))
        now = stage(now.withColumn("full", over))


def by_source(sized: DataFrame, rule: DataFrame, sources: int) -> DataFrame:
    """sized with the columns of rule (s, ...), one row a source at most, and `sources` in all."""
    same = sized.source.eqNullSafe(rule.s)
    if sources <= MOST_SOURCES:
        return sized.join(F.broadcast(rule), same)
    salted = rule.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sized.join(salted, sized.source.eqNullSafe(salted.s) & (F.pmod("h", F.lit(SALTS)) == salted.salt)).drop("salt")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row; copies is how often the mix takes the document."""
    sized = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = stage(goal.withColumn("whole", whole.cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    sources = goal.count()
    # (source, need, low): documents with a hash below low are in, those from low on up to the bucket's end are open
    open_, width = goal.select("source", "need", F.lit(0).cast("long").alias("low")), 60
    for level in range(LEVELS):
        step = 1 << (width - BITS)
        mine = by_source(sized.where("size > 0"), open_.withColumnRenamed("source", "s"), sources).where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << width)))
        sums = mine.groupBy("source", "low", "need", ((F.col("h") - F.col("low")) / step).cast("long").alias("bucket")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("before", run - F.col("size"))
        if level < LEVELS - 1:
            at = sums.where(F.col("before") <= F.col("need")).groupBy("source").agg(F.max_by(F.struct("low", "need", "bucket", "before"), "bucket").alias("b"))
            open_ = stage(at.select("source", (F.col("b.need") - F.col("b.before")).alias("need"), (F.col("b.low") + F.col("b.bucket") * step).alias("low")))
        else:  # buckets of one hash: all below the open one are in
            taken = sums.where((F.col("before") + F.col("size") / 2 <= F.col("need")) & (F.col("need") > 0)).groupBy("source").agg(F.max(F.col("low") + F.col("bucket")).alias("last"))
            none = open_.select("source", (F.col("low") - 1).alias("last"))
            last = none.unionByName(taken).groupBy("source").agg(F.max("last").alias("last"))
        width -= BITS
    rule = goal.join(last, goal.source.eqNullSafe(last.source), "left").select(goal.source.alias("s"), "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last"))
    return by_source(sized, rule, sources).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.when((F.col("h") <= F.col("last")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that the mix takes, each as often as it is taken. Documents without words stay once."""
    own, source, n, k = free(docs.columns, "__id", "__source", "__n", "__k")
    rule = mix(docs, **options).groupBy("doc_id", "source").agg(F.max("copies").alias("copies"), F.max("size").alias("size"))
    rule = rule.select(F.col("doc_id").alias(own), F.col("source").alias(source), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias(n))
    both = F.col("doc_id").eqNullSafe(F.col(own)) & F.col("source").eqNullSafe(F.col(source))
    return docs.join(rule, both).where(F.col(n) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS n, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source),
-- the cap binds for the least n / w first: unit is the share of a unit of weight when the first k sources are capped
o AS (
  SELECT *, coalesce(sum(2 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(n) OVER () AS everything
  FROM s),
u AS (SELECT arg_min((1.5 * everything - capped) / free, n / w) FILTER (WHERE (1.5 * everything - capped) / free * w < 2 * n) AS unit FROM o),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size, least(2 * n, coalesce(unit, 1e18) * w) AS target FROM s, u),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) - sum(size) OVER (PARTITION BY d.source, h) AS before, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (whole + CASE WHEN size > 0 AND before + own / 2.0 <= target - whole * source_size AND target - whole * source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))
