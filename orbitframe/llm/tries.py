"""Prefix trie of conversations by prefix doubling.

Turns are named by dense numbers, equal turns (role and text) by the same. Blocks of 2, 4, 8, ... turns that begin at a multiple of their length
are named from the names of their halves, one join round a length. The first d turns are blocks by the binary digits of d, longest first, so a
prefix's name comes from the name of the prefix without its last block and that block: all d with r binary ones are named in round r. Prefixes
of one length are equal if their names are, and a node is a (depth, name). Rounds grow with the logarithm of the longest conversation; the
blocks of all lengths together are at most twice the turns.

A node is known by its least member. The nodes that one conversation is the least member of form a chain that ends with its last turn, and the
chains cut the trie into paths. So what is summed over a subtree (leaves, saved tokens) is, for each member, what lies on its own chain at this
depth or below: one running sum along chains, one join by conversation and one grouping by node, however deep the trie is.

Nothing depends on how often a turn, a prefix or a conversation occurs: distinct names are combined before they are shuffled, names come back by
joins that Spark may split, turns are numbered by ranges that may cut a conversation, and running sums go by blocks of SPAN turns. The ids that
end at a node are joined by ranges too; only SHA-256 itself has to read them one after the other, as a stream in constant memory.

Defined cases: turns go by turn (null first), then role and text, equal rows staying as turns; null role or text is empty; rows with a null
conv_id belong to no conversation; negative ids have the remainder of their sign; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.llm.common import spread, stage, table
from orbitframe.llm.mixing import size_of

SPAN, JOINED = 4096, 10_000


def dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with name: the distinct values of the keys, numbered from 0 without gaps. Numbers begin, in each bucket of keys, after those of the
    buckets before it; there are as many buckets as shuffle partitions."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(spread(rows.sparkSession))).alias("bucket")
    found = rows.select(*keys).distinct().select(bucket, *keys)
    numbered = found.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)))
    sizes = numbered.groupBy("bucket").agg(F.max("k").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # one row a bucket
    names = numbered.join(F.broadcast(before), "bucket").select(*keys, (F.col("before") + F.col("k") - 1).alias("name"))
    return rows.join(names, keys)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, name, words): turns numbered from 1 in each conversation, with the dense name of (role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("line"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("line")]
    dealt = turns.repartitionByRange(spread(conversations.sparkSession), *order).sortWithinPartitions(*order)
    whole = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = stage(dealt.select("conv_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"), whole.alias("turn_key"), size_of(F.col("text")).alias("words")))
    parts = rows.groupBy("conv_id", "p").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("p")) - F.col("n")  # a row for each range that holds the conversation
    placed = rows.join(parts.select("conv_id", "p", "first", earlier.alias("earlier")), ["conv_id", "p"])
    return stage(dense(placed.select("conv_id", (F.col("at") - F.col("first") + F.col("earlier") + 1).alias("pos"), "turn_key", "words"), ["turn_key"]).drop("turn_key"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, total) and their turns (conv_id, pos, name, words, total): the first h turns of the twenty's first conversation,
    then the conversation's own after its first h."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h")
    convs = own.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % 20).alias("donor"))
    convs = convs.join(own.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n")), "donor", "left")
    taken = F.least("h", F.coalesce("donor_n", F.lit(0)))
    convs = stage(convs.select("conv_id", "donor", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    first = turns.where("pos <= 3").select(F.col("conv_id").alias("donor"), "pos", "name", "words")
    heads = convs.where("taken > 0").join(first, "donor").where("pos <= taken").select("conv_id", "pos", "name", "words", "total")
    tails = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "words", "total")
    return convs.select("conv_id", "total"), stage(heads.unionByName(tails))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, name, words, total) of each turn (conv_id, pos, name, words, total): name is that of the first d = pos turns, among those of d."""
    longest = turns.agg(F.max("pos")).first()[0] or 0
    blocks, ends = turns.select("conv_id", (F.col("pos") - 1).alias("j"), "name"), []
    for k in range(max(1, longest.bit_length())):
        if k:
            half = [F.max(F.when(F.col("j") % 2 == i, F.col("name"))).alias(c) for i, c in enumerate("ab")]
            pairs = blocks.groupBy("conv_id", F.floor(F.col("j") / 2).alias("j")).agg(*half).where("b is not null")
            blocks = stage(dense(pairs, ["a", "b"]).select("conv_id", "j", "name"))
        # the last block of the prefix of (j + 1) * 2^k turns; the prefix before it has j * 2^k
        ends.append(blocks.where("j % 2 = 0").select("conv_id", (F.col("j") * (1 << k)).alias("before"), ((F.col("j") + 1) * (1 << k)).alias("d"), F.col("name").alias("b")))
    last = ends[0]
    for more in ends[1:]:
        last = last.unionByName(more)
    last = stage(last)
    named = [last.where("before = 0").select("conv_id", "d", F.col("b").alias("name"))]
    for ones in range(2, longest.bit_length() + 1):
        shorter = named[-1].select("conv_id", F.col("d").alias("before"), F.col("name").alias("a"))
        grown = last.where(F.bit_count("d") == ones).join(shorter, ["conv_id", "before"])
        named.append(stage(dense(grown.select("conv_id", "d", "a", "b"), ["d", "a", "b"]).select("conv_id", "d", "name")))
    every = named[0]
    for more in named[1:]:
        every = every.unionByName(more)
    return stage(every.join(turns.select("conv_id", F.col("pos").alias("d"), "words", "total"), ["conv_id", "d"]))


def _joined(frames: Iterator) -> Iterator:
    """Of rows (d, name, conv_id) in this order: the decimal ids of a run joined by commas, at most JOINED in a row."""
    import pandas as pd

    for f in frames:
        d, name, ids = f.d.to_numpy(), f.name.to_numpy(), f.conv_id.to_numpy()
        new = np.ones(len(f), bool)
        new[1:] = (d[1:] != d[:-1]) | (name[1:] != name[:-1])
        begin = np.flatnonzero(new)
        begin = np.concatenate([np.arange(a, b, JOINED) for a, b in zip(begin, np.append(begin[1:], len(f)), strict=True)]) if len(f) else begin
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(begin, np.append(begin[1:], len(f)), strict=True)]
        yield pd.DataFrame({"d": d[begin], "name": name[begin], "first": ids[begin], "text": text})


def _digested(frames: Iterator) -> Iterator:
    """SHA-256 of the texts of each (d, name), rows in order; a node may go on in the next batch."""
    import pandas as pd

    key, state, schema = None, None, {"d": "int64", "name": "int64", "ends_sha256": "object"}
    for f in frames:
        done = []
        for d, name, text in zip(f.d.tolist(), f.name.tolist(), f.text, strict=True):
            if (d, name) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (d, name), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pd.DataFrame(done, columns=list(schema)).astype(schema)
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=list(schema))


def ends(last: DataFrame) -> DataFrame:
    """(d, name, ends_sha256) of the nodes (d, name) that conversations conv_id end at."""
    n = spread(last.sparkSession)
    ordered = last.repartitionByRange(n, "d", "name", "conv_id").sortWithinPartitions("d", "name", "conv_id")
    texts = ordered.mapInPandas(_joined, "d long, name long, first long, text string")
    return texts.repartition(n, "d", "name").sortWithinPartitions("d", "name", "first").mapInPandas(_digested, "d long, name long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, the root included."""
    convs, turns = rebuilt(numbered_turns(conversations))
    rows = prefixes(turns)
    node = ["d", "name"]
    nodes = rows.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.count_if(F.col("d") == F.col("total")).alias("n_ends"))
    value, leaf = (F.col("n_convs") - 1) * F.col("words"), (F.col("n_ends") == F.col("n_convs")).cast("long")
    nodes = stage(nodes.select(*node, "conv_id", "n_convs", value.alias("value"), leaf.alias("leaf")))

    # chains: the nodes of one least member; a running sum from their end, by blocks of SPAN depths
    block = F.floor(F.col("d") / SPAN).alias("block")
    blocks = nodes.groupBy("conv_id", block).agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaf"), F.min("d").alias("head"), F.max("d").alias("end"))
    one, below = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy(F.desc("block"))
    blocks = stage(blocks.select(
        "conv_id", "block", (F.sum("value").over(below) - F.col("value")).alias("later"), F.sum("value").over(one).alias("value"),
        F.sum("leaf").over(one).alias("leaf"), F.min("head").over(one).alias("head"), F.max("end").over(one).alias("end"),
    ))
    chains = blocks.select("conv_id", "value", "leaf", "head", "end").distinct()
    inner = F.sum("value").over(Window.partitionBy("conv_id", "block").orderBy(F.desc("d")))
    own = nodes.select(*node, "conv_id", "n_convs", "value", block).select(*node, "conv_id", "n_convs", "block", inner.alias("inner"))
    own = own.join(blocks.drop("value"), ["conv_id", "block"])

    # chains that begin below a node: all of what lies on them belongs to it
    above = rows.select("conv_id", *node).join(chains.where("head > 1"), "conv_id").where("d < head")
    under = above.groupBy(*node).agg(F.sum("value").alias("u_value"), F.sum("leaf").alias("u_leaf"), F.count_if(F.col("d") == F.col("head") - 1).alias("u_heads"))
    parents = above.where("d = head - 1").select(*node, F.col("conv_id").alias("child")).join(nodes.select(*node, "conv_id"), node).select("child", F.col("conv_id").alias("p_id"))

    summed = convs.agg(F.min("conv_id"), F.count("*")).first()
    digest = ends(rows.where("d = total").select(*node, "conv_id").unionByName(convs.where("total = 0").select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"), "conv_id")))
    digest = stage(digest)
    empty = F.lit(hashlib.sha256(b"").hexdigest())

    out = own.join(under, node, "left").join(digest, node, "left")
    out = out.join(parents, out.conv_id == parents.child, "left")
    parent = F.when(F.col("d") > F.col("head"), F.col("conv_id")).when(F.col("d") == 1, F.lit(summed[0])).otherwise(F.col("p_id"))
    zero = F.lit(0)
    below_root = out.select(
        "conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), "n_convs", ((F.col("d") < F.col("end")).cast("long") + F.coalesce("u_heads", zero)).alias("n_children"),
        (F.col("leaf") + F.coalesce("u_leaf", zero)).alias("n_leaves"), (F.col("inner") + F.col("later") + F.coalesce("u_value", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    if not summed[1]:
        return below_root
    children, leaves, saved = nodes.agg(F.count_if(F.col("d") == 1), F.sum("leaf"), F.sum("value")).first()
    at_root = digest.where("d = 0").first()  # one row at most
    long = lambda x: F.lit(x).cast("long")
    root = conversations.sparkSession.range(1).select(
        long(summed[0]).alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"), long(summed[1]).alias("n_convs"), long(children).alias("n_children"),
        long(leaves or 1).alias("n_leaves"), long(saved or 0).alias("saved_tokens"), (F.lit(at_root["ends_sha256"]) if at_root else empty).alias("ends_sha256"),
    )
    return below_root.unionByName(root)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id: its bytes one after the other, eight bits each
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
             lambda s, b: list_reduce(list_prepend(xor(s, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda v, i: xor(v // 2, 3988292384 * (v % 2)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
g AS (
  SELECT c.conv_id, t.pos, t.turn, t.words FROM c JOIN t ON t.conv_id = c.donor AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos + 1000, t.turn, t.words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
r AS (SELECT conv_id, row_number() OVER w AS d, words, list(sha256(turn)) OVER w AS key, count(*) OVER (PARTITION BY conv_id) AS total FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
p AS (
  SELECT conv_id, d, words, total, array_to_string(key, '-') AS key, array_to_string(key[1:d - 1], '-') AS parent FROM r
  UNION ALL SELECT conv_id, 0, 0, coalesce(total, 0), '', NULL FROM c LEFT JOIN (SELECT DISTINCT conv_id, total FROM r) USING (conv_id)),
n AS (
  SELECT d, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS value,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = total) AS ends
  FROM p GROUP BY d, key),
k AS (SELECT d - 1 AS d, parent AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
-- every node counts for the node of its least member at each depth down to its own
a AS (
  SELECT p.d, p.key, sum(n.value) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM n LEFT JOIN k ON n.d = k.d AND n.key = k.key JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN a ON n.d = a.d AND n.key = a.key LEFT JOIN k ON n.d = k.d AND n.key = k.key LEFT JOIN n u ON u.d = n.d - 1 AND u.key = n.parent
"""
