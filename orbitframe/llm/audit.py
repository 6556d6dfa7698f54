"""Audit of how five filters interact, from a histogram of failure masks.

Every document gets five bits, one for each filter it fails: A under 100 words; B under 80 distinct words of 100; C over 10 capitals A-Z of 100
characters; D one of # $ % & * |; E a smaller id has the same text. Four bits are functions of the text; the fifth comes from a grouping of
the texts, by their SHA-256, that finds each text's least id. Documents are then summed into 32 cells for each part, and what any order of the
filters keeps, removes or loses at any step follows from the cells alone: a step is known by the filters before it and its own (80 cases), so
nothing is filtered 120 times.

All sums are combined before they are shuffled: a text that a third of the rows share is one row a task, and after the grouping by text a row
for each part and label. Texts do not leave their task; 60 bytes of a document do.

Defined cases: a null text is empty; a null language is the part ''; rows of one id are equals, so none makes another fail E; rows with a
null id never fail E, make none fail, and have no labels; of several labels of an id one with value 1 is enough; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.llm.common import table

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at the text alone; text is not null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    fails = {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(c, BIT[k]).otherwise(0) for k, c in fails.items()), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and among them those with quality 1 and with toxic 1, for each part and mask that occurs."""
    text = F.coalesce("text", F.lit(""))
    marked = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_mask(text).alias("mask"))
    each = marked.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    each = each.join(known, "doc_id", "left").select("doc_id", "part", "same", "mask", "n", *flags)
    # of each text: rows, rows of the least id, and rows without an id
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = each.groupBy("same", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    first = F.min("least.doc_id").over(Window.partitionBy("same"))  # a row for each part and label
    texts = texts.withColumn("stay", F.col("free") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    sides = F.array(F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    rows = texts.select("part", "good", "toxic", F.explode(sides).alias("e")).where("e.n > 0")
    counted = [F.sum("e.n").alias("n"), *(F.sum(F.when(F.col(c), F.col("e.n")).otherwise(0)).alias(c) for c in ("good", "toxic"))]
    return rows.groupBy("part", F.col("e.mask").alias("mask")).agg(*counted)


def report(found: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, of the cells (part, mask, n, good, toxic)."""
    orders: dict[tuple[int, int], list[str]] = {}
    for order in permutations(FILTERS):
        for step, name in enumerate(order):
            orders.setdefault((sum(BIT[x] for x in order[:step]), BIT[name]), []).append("".join(order))
    cases = F.array(*(F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit")) for before, bit in orders))
    cased = found.select("*", F.explode(cases).alias("c")).select("*", "c.before", "c.bit")
    mask, fails = F.col("mask"), F.col("mask").bitwiseAND(F.col("bit")) > 0
    reached = mask.bitwiseAND(F.col("before")) == 0

    def total(of: str | Column, when: Column) -> Column:
        return F.sum(F.when(when, of if isinstance(of, Column) else F.col(of)).otherwise(0))

    # of the orders of a mask's filters each of them is first as often as the others
    turns = F.col("n") * F.element_at(F.array(*(F.lit(120 // k) for k in range(1, 6))), F.bit_count(mask).cast("int"))
    summed = cased.groupBy("part", "before", "bit").agg(
        total("n", reached & ~fails).alias("kept"), total("n", reached & fails).alias("removed"), total("n", ~reached & fails).alias("redundant"), total("n", mask == F.col("bit")).alias("unique_fails"),
        total("good", reached & fails).alias("good_lost"), total("toxic", reached & fails).alias("toxic_lost"), total(turns, fails).alias("shapley"),
    )
    names = F.create_map(*(x for (before, bit), o in orders.items() for x in (F.lit(before * 32 + bit), F.lit(o))))
    step = (F.bit_count("before") + 1).cast("int").alias("step")
    return summed.select("part", F.explode(F.element_at(names, F.col("before") * 32 + F.col("bit"))).alias("filter_order"), step, "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT w.doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e
  FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CAST(a AS INTEGER) + 2 * CAST(b AS INTEGER) + 4 * CAST(c AS INTEGER) + 8 * CAST(d AS INTEGER) + 16 * CAST(e AS INTEGER) AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
-- every document goes through every order
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT k1.name || k2.name || k3.name || k4.name || k5.name AS filter_order, [k1.bit, k2.bit, k3.bit, k4.bit, k5.bit] AS bits
  FROM k k1, k k2, k k3, k k4, k k5 WHERE k1.bit | k2.bit | k3.bit | k4.bit | k5.bit = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
         count(*) FILTER (WHERE mask & before = 0 AND mask & bit = 0) AS kept, count(*) FILTER (WHERE mask & before = 0 AND mask & bit > 0) AS removed,
         count(*) FILTER (WHERE mask & before > 0 AND mask & bit > 0) AS redundant, count(*) FILTER (WHERE mask = bit) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
