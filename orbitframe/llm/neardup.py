"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's elements are its runs of five words (lower-cased in A-Z, split at space and U+0009 to U+000D; a shorter text is one element), with
weight 1 + ln(count). Each element's arrivals are a Poisson process with its weight as rate; each arrival falls on one of `bands * rows`
registers, the earliest element stays, and an element stops as soon as it is later than every register. Two texts agree in a register with
the probability Jaccard of their weighted elements. The first `plain` bands take all weights as 1, for which that is the Jaccard similarity of
the sets, whatever is repeated in one text alone. Texts that agree in all registers of a band are candidates; a candidate pair is a link if
the exact Jaccard similarity of the two sets of elements is at least `threshold`. With 16 plain bands of 4 a pair at 0.8 is missed at most
once in 4600, one at 0.85 once in 130000. Classes are the connected components of the links.

Texts with equal elements form one node beforehand, so copies never multiply. Every member is verified against the least leader of its
buckets, not against each other; members of buckets that are still apart are verified against further leaders with many links. Members of buckets that are then
still in several classes are split exactly: they are dealt by their rarest elements, as many as two sets at the threshold must share one
of (`meeting`), and every pair in different classes that meets there and that bounds on the overlap let through is verified. No link among
them is lost. All of it is joins on hashed keys that Spark can split.

Defined cases: a null text is empty; a text without words is alone in its class; rows of one id are one document and share its class;
rows with a null id have no class (null) and join nobody; columns other than doc_id and text are ignored (keep_one carries them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import WordHash, chunks, discard, free, mix, offsets, stage, starts, table, windows

WORDS, BANDS, PLAIN, ROWS, THRESHOLD, PARITY = 5, 24, 16, 4, 0.8, 8
KEY = ["doc_id", "t"]


def elements(texts: list[bytes], cache: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text, ascending, their weights, and where each text's begin."""
    words = [t.lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    h = cache.of([x for w in words for x in w])
    pos, doc = starts(lengths, WORDS)
    parts, docs = [windows(h, WORDS)[pos]], [doc]
    at = offsets(lengths)
    for i in np.flatnonzero((lengths > 0) & (lengths < WORDS)):
        parts.append(windows(h[at[i] : at[i + 1]], int(lengths[i])))
        docs.append(np.array([i]))
    e, d = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((e, d))
    e, d = e[order], d[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(e)))
    return e[first], 1 + np.log(counts), np.searchsorted(d[first], np.arange(len(texts) + 1))


def signatures(e: np.ndarray, w: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The element in each of m registers of each text."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    reg, won = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    live, time, step, block = np.arange(len(e)), np.zeros(len(e)), 0, 1
    while len(live):
        draw = mix(e[live, None] + np.arange(step + 1, step + block + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[live, None]
        when = time[live, None] + np.cumsum(gaps, axis=1)
        slot = doc[live, None] * m + (mix(draw) % np.uint64(m)).astype(np.int64)
        x, s = when.ravel(), slot.ravel()
        good = x < reg[s]
        x, s, who = x[good], s[good], np.repeat(e[live], block)[good]
        np.minimum.at(reg, s, x)
        hit = reg[s] == x
        won[s[hit]] = who[hit]
        time[live] = when[:, -1]
        live = live[time[live] < reg.reshape(n, m).max(axis=1)[doc[live]]]
        step, block = step + block, min(32, block * 2 if step else 1)
    return won.reshape(n, m)


def _signed(bands: int, plain: int, rows: int):
    def run(batches):
        cache = WordHash()
        for batch in chunks(batches, budget=2 << 20):
            e, w, at = elements(batch["text"].to_pylist(), cache)
            both = signatures(e, np.ones_like(w), at, plain * rows), signatures(e, w, at, (bands - plain) * rows)
            sig = np.concatenate(both, axis=1).reshape(-1, bands, rows)
            code = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
            for r in range(rows):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            n = np.diff(at)
            digest = [hashlib.blake2b(e[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(n))]
            flat = pa.array(code.view(np.int64)[n > 0].ravel())
            lists = pa.ListArray.from_arrays(pa.array(offsets(np.where(n > 0, bands, 0)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["t"], pa.array(digest, pa.binary()), pa.array(n, pa.int32()), lists], names=["doc_id", "t", "same", "n", "bands"])

    return run, "doc_id long, t long, same binary, n int, bands array<long>"


def _pack(batches):
    packer = zstandard.ZstdCompressor(level=1)
    for batch in chunks(batches):
        z = [packer.compress(x) for x in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["t"], pa.array(z, pa.binary())], names=["doc_id", "t", "z"])


def parities(e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text PARITY words of 64 bits: each element turns one bit over, so two texts' bits differ in no more places than their sets do."""
    n = len(at) - 1
    slot = np.repeat(np.arange(n), np.diff(at)) * (PARITY * 64) + (mix(e) % np.uint64(PARITY * 64)).astype(np.int64)
    odd = (np.bincount(slot, minlength=n * PARITY * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, PARITY)


def _sets(batches):
    cache, unpack = WordHash(), zstandard.ZstdDecompressor()
    for batch in chunks(batches, "z", budget=1 << 20, rows=128):
        e, _, at = elements([unpack.decompress(z) for z in batch["z"].to_pylist()], cache)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * PARITY, pa.int32()), pa.array(parities(e, at).ravel()))
        yield pa.RecordBatch.from_arrays([batch["node"], batch["t"], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(e.view(np.int64))), bits], names=["node", "t", "items", "bits"])


def meeting(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of sets (node, t, comp, items, bits) of different classes, among them every pair whose Jaccard similarity is at least the
    threshold. Of all elements in an order, such a pair shares one of the first n - ceil(threshold * n) + 1 of either set. Elements that only
    one class has come first in the order and meet nobody, then the rarest; sizes, places and parities bound the overlap before a pair is made."""
    each = stage(sets.select("node", "t", "comp", F.explode("items").alias("x")))
    across = each.groupBy("x").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("x", "df")
    order = each.join(across, "x").groupBy("node", "t").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("order"))
    order = order.join(sets.select("node", "t", "comp", "bits", F.size("items").alias("n")), ["node", "t"])
    alone = F.col("n") - F.size("order")
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - alone
    keyed = order.where(first > 0).select("node", "comp", "n", "bits", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), first.cast("int"))).alias("k", "e"))
    keyed = stage(keyed.select("node", "comp", "n", "bits", "alone", "k", F.col("e.x").alias("x")))
    discard(each)
    kept = keyed.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("x")
    one = keyed.join(kept, "x")
    two = one.select("x", *(F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "bits", "alone", "k")))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_b")) - 1e-6
    after = F.least(F.col("n") - F.col("alone") - F.col("k"), F.col("n_b") - F.col("alone_b") - F.col("k_b"))
    differ = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(PARITY)), F.lit(0))
    able = (F.least("n", "n_b") >= need) & (F.least("k", "k_b") + after >= need) & (F.col("n") + F.col("n_b") - differ >= 2 * need)
    return one.join(two, "x").where((F.col("comp") < F.col("comp_b")) & able).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) of each node: the least node that the links (a, b) connect it to. Labels spread and shortcut until nothing changes."""
    links = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(nodes.select("node", F.col("node").alias("comp")))
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("comp").alias("least"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "comp", F.least("comp", F.coalesce("least", "comp")).alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("there"))
        new = stage(step.join(jump, step.next == jump.at, "left").select("node", F.least("next", F.coalesce("there", "next")).alias("comp"), (F.col("next") < F.col("comp")).alias("moved")))
        discard(labels)
        labels = new.drop("moved")
        if not new.where("moved").head(1):
            discard(links)
            return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, plain: int = PLAIN, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least id of the class."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    signed = stage(keyed.mapInArrow(*_signed(bands, plain, rows)))
    full = signed.where("n > 0 and doc_id is not null")
    node = full.groupBy("same").agg(F.min(F.struct("doc_id", "t", "n", "bands")).alias("r")).select(F.col("r.doc_id").alias("node"), F.col("r.t").alias("t"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands"))
    placed = node.select("node", "t", "n", F.posexplode("bands").alias("band", "code"))
    shared = placed.groupBy("band", "code").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    members = stage(placed.join(shared, ["band", "code"]))
    live = members.select(F.col("node").alias("doc_id"), "t").distinct()
    packed = keyed.mapInArrow(_pack, "doc_id long, t long, z binary").join(live, KEY).dropDuplicates(KEY).select(F.col("doc_id").alias("node"), "t", "z")
    sets = stage(packed.mapInArrow(_sets, "node long, t long, items array<long>, bits array<long>"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) those with enough elements in common."""
        a, b = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(a, "a").join(b, "b").where(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")

    def alike(a: str, b: str):
        """Sizes that allow the threshold at all."""
        return (F.col(a) >= F.lit(threshold) * F.col(b) - 1e-9) & (F.col(b) >= F.lit(threshold) * F.col(a) - 1e-9)

    nodes = live.select(F.col("doc_id").alias("node")).distinct()
    # rows of one id are one document, whatever their texts
    ids = full.select("same", "doc_id").distinct()
    least = full.groupBy("same").agg(F.min("doc_id").alias("node"))
    # one leader for each member, as most members of a group share a band with its least node; other leaders only where that does not do
    links = stage(linked(members.where("node != leader").groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("b"))))
    comp = components(nodes, links)
    size = members.select("node", "n").distinct().groupBy("node").agg(F.max("n").alias("n"))
    for turn in range(3):
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        now = stage(members.select("band", "code", "node").join(comp, "node").join(size, "node").join(degree, "node", "left"))
        luck = F.coalesce("degree", F.lit(0)) * F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1000))
        split = now.groupBy("band", "code").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by(F.struct("node", "comp", "n"), F.struct(luck, "node")).alias("lead")).where("lo < hi").select("band", "code", F.col("lead.node").alias("b"), F.col("lead.comp").alias("lead_comp"), F.col("lead.n").alias("lead_n"))
        if not split.head(1):
            discard(now)
            break
        if turn < 2:
            pairs = now.join(split, ["band", "code"]).where((F.col("comp") != F.col("lead_comp")) & alike("n", "lead_n")).select(F.col("node").alias("a"), "b").distinct()
        else:  # whatever is still apart
            apart = now.join(split.select("band", "code"), ["band", "code"]).select("node", "comp").distinct()
            pairs = meeting(sets.join(apart, "node"), threshold)
        more = stage(linked(pairs))
        discard(now, pairs)
        if more.head(1):
            links = links.unionByName(more)
            discard(comp)
            comp = components(nodes, links)
        else:
            discard(more)
    discard(members, sets, links)  # what is left reads signatures and classes alone
    found = ids.join(least, "same").join(comp.withColumnRenamed("comp", "c"), "node", "left").select("doc_id", F.coalesce("c", "node").alias("c"))
    found = found.groupBy("doc_id").agg(F.min("c").alias("class_id"))
    return signed.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, of each class only the one with the least id, and one row of it; rows with a null id stay."""
    (own,) = free(docs.columns, "__id")
    out = classes(docs, threshold).where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(out, F.col("doc_id") == F.col(own)).drop(own).dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
