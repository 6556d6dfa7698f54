"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions alone.

The lexicon is a band of inverse document frequency over the whole table: terms in two documents at least, in no less than `least` and no
more than `most` of all. A band has at most 1 / least times as many terms as a document has on average, however many documents there are; up
to MOST_TERMS of them are a set in the plan, beyond it the terms of the texts are joined to the band by a shuffle, with the same result.

A text's distinct lexicon terms are sorted and hashed once for each of several random subsets of the lexicon. Subsets of four densities
(a quarter of the lexicon, a 16th, a 64th, a 256th; PER_DENSITY of each) serve short and long texts: two fingerprints are as alike as the
share of equal hashes among the subsets in which either text has a term, in the sparsest density of which either text fills half. A text
without any lexicon term is fingerprinted by all its distinct words in the same way, marked by '='.

The next document (by descending id, after the last the first) is found on ids alone: they are dealt by range, each range looks ahead by
itself, and only the ranges' heads, one row a partition, are put in order together.

Defined cases: a null text is empty; two empty texts are alike; rows of one id go by descending hash of their text, equal rows are one
document in the order; null ids come last; a single document is next to itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.llm.common import spread, stage, table

PER_DENSITY, MOST_TERMS = 8, 100_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def subsets() -> list[tuple[int, int, int]]:
    """(shift, mask, value) of the bits of a term's hash that put it into each subset, densest first."""
    out = [(0, 3, v) for v in range(4)] + [(2, 3, v) for v in range(PER_DENSITY - 4)]
    for shift, mask in ((4, 15), (8, 63), (14, 255)):
        out += [(shift, mask, v) for v in range(PER_DENSITY)]
    return out


def terms(text: Column) -> Column:
    """Hashes of the distinct words."""
    return F.transform(F.array_distinct(F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, least: float = 0.0025, most: float = 0.05) -> DataFrame:
    """(h): hashes of the terms of the band, by document frequency over all rows."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return stage(df.where((F.col("df") <= F.lit(most) * n) & (F.col("df") >= F.lit(max(2.0, least * n)))).select("h"))


def fingerprint(own: Column, everything: Column) -> Column:
    """Of the sorted hashes of a text's lexicon terms: 24-bit hashes of the subsets joined by '-', empty where a subset has no term; '=' and those
    of all the text's terms where there are none. Both arguments are columns that exist already, so the text is split once."""
    rules = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(m).cast("long").alias("m"), F.lit(v).cast("long").alias("v")) for s, m, v in subsets()))

    def digests(h: Column) -> Column:
        def digest(rule: Column) -> Column:
            part = F.filter(h, lambda x: F.call_function("shiftrightunsigned", x, rule["s"]).bitwiseAND(rule["m"]) == rule["v"])
            return F.transform(F.array(part), lambda x: F.when(F.size(x) > 0, F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFF))))).otherwise(""))[0]

        return F.array_join(F.transform(rules, digest), "-")

    return F.when(F.size(own) > 0, digests(own)).otherwise(F.concat(F.lit("="), digests(F.array_sort(everything))))


def likeness(a: str, b: str) -> Column:
    x, y = (F.split(F.ltrim(F.col(c), F.lit("=")), "-") for c in (a, b))
    pairs = F.zip_with(x, y, lambda p, q: F.struct((p == q) & (p != ""), (p != "") | (q != ""), p != "", q != "").alias("e"))

    def count(part: Column, name: str) -> Column:
        return F.size(F.filter(part, lambda e: e[name]))

    alike = F.lit(0.0)
    for k in range(4):  # the sparsest density that is filled by half wins
        part = F.slice(pairs, k * PER_DENSITY + 1, PER_DENSITY)
        share = F.try_divide(count(part, "col1"), count(part, "col2"))
        enough = F.least(count(part, "col3"), count(part, "col4")) * 2 >= PER_DENSITY
        alike = F.coalesce(share, F.lit(0.0)) if k == 0 else F.when(enough, share).otherwise(alike)
    kinds = F.col(a).startswith("=") != F.col(b).startswith("=")
    return F.when(F.col(a) == F.col(b), 1.0).when(kinds, 0.0).otherwise(alike)


def successors(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys with next_<column> for each column of `order`: the row that follows by descending order, nulls last, the first after the last."""
    by = [F.desc_nulls_last(c) for c in order]
    dealt = stage(keys.repartitionByRange(spread(keys.sparkSession), *by).withColumn("p", F.spark_partition_id()))
    whole = F.struct(*order)
    ahead = dealt.withColumn("n", F.lead(whole).over(Window.partitionBy("p").orderBy(*by)))
    heads = stage(dealt.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(*by))).where("r = 1").select("p", whole.alias("head")))
    line = Window.orderBy("p")  # one row a partition
    after = heads.select("p", F.coalesce(F.lead("head").over(line), F.first("head").over(line.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    out = ahead.join(F.broadcast(after), "p").withColumn("n", F.coalesce("n", "after"))
    return out.select(*keys.columns, *(F.col(f"n.{c}").alias(f"next_{c}") for c in order))


def edits(docs: DataFrame, band: DataFrame) -> DataFrame:
    """band: (h), the lexicon. (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    text = F.coalesce("text", F.lit(""))
    # nulls made comparable, so that joins, duplicates and their shuffles all go by the same plain columns
    own_key, next_key = ["k", "none", "t"], ["next_k", "next_none", "next_t"]

    def keyed(prefix: str) -> list[Column]:
        c = F.col(f"{prefix}doc_id")
        return [F.coalesce(c, F.lit(0)).alias(f"{prefix}k"), c.isNull().alias(f"{prefix}none")]

    texts = docs.select(*keyed(""), F.xxhash64(text).alias("t"), text.alias("text"))
    keys = docs.select("doc_id", F.xxhash64(text).alias("t"), F.length(text).alias("n_chars")).distinct()
    line = stage(successors(keys, ["doc_id", "t"]).select("*", *keyed(""), *keyed("next_")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # both joins shuffle the same columns of the texts by the same key, so Spark shuffles them once; of equal next rows one serves
    other = texts.toDF("next_k", "next_none", "next_t", "text")
    tails = line.join(other, next_key).select(*own_key, "doc_id", "n_chars", "next_doc_id", "next_t", F.substring("text", F.lit(1), half).alias("tail")).dropDuplicates(own_key)
    both = texts.join(tails, own_key).select("doc_id", "t", "n_chars", "next_doc_id", "next_t", "text", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.col("tail")).alias("edited"))
    fixed = ["doc_id", "t", "n_chars", "next_doc_id", "next_t"]
    split = both.select(*fixed, F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("w0"), terms(F.col("edited")).alias("w1"))

    if band.count() <= MOST_TERMS:
        known = ",".join(f"{r['h']}L" for r in band.collect()) or "NULL"
        kept = split.select(*fixed, "edited_sha256", "w0", "w1", *(F.array_sort(F.expr(f"filter({w}, h -> h IN ({known}))")).alias(k) for w, k in (("w0", "k0"), ("w1", "k1"))))
    else:
        split = stage(split.withColumn("row", F.monotonically_increasing_id()))
        each = split.select("row", F.explode(F.array(F.struct(F.lit("k0").alias("k"), F.col("w0").alias("w")), F.struct(F.lit("k1").alias("k"), F.col("w1").alias("w")))).alias("e"))
        found = each.select("row", "e.k", F.explode("e.w").alias("h")).join(band, "h").groupBy("row").agg(*(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("h")))).alias(k) for k in ("k0", "k1")))
        none = F.array().cast("array<long>")
        kept = split.join(found, "row", "left").select(*fixed, "edited_sha256", "w0", "w1", F.coalesce("k0", none).alias("k0"), F.coalesce("k1", none).alias("k1"))
    prints = kept.select(*fixed, "edited_sha256", fingerprint(F.col("k0"), F.col("w0")).alias("fingerprint"), fingerprint(F.col("k1"), F.col("w1")).alias("edited_fingerprint"))
    out = stage(prints)
    other = out.select(F.col("doc_id").alias("o_id"), F.col("t").alias("o_t"), F.col("fingerprint").alias("other")).dropDuplicates(["o_id", "o_t"])
    out = out.join(other, out.next_doc_id.eqNullSafe(other.o_id) & (out.next_t == other.o_t))
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "other").alias("near_next"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edits(docs, lexicon(docs))
