"""SimHash classes by covering locality-sensitive hashing.

A text's shingles are its runs of four words, repeats included (lower-cased in A-Z, split at space and U+0009 to U+000D, joined by one space; a
shorter text is one shingle). Bit i of the fingerprint is set if it is set in over half of the shingles' XXH64 (seed 42). Two fingerprints
are linked if at most RADIUS (even) of the 64 bits differ; classes are the connected components of the links.

Each bit position has a nonzero vector of RADIUS + 1 bits, and each nonzero vector v one mask: the positions whose vector has an odd scalar
product with v. The vectors of RADIUS positions span less than the space, so some v is orthogonal to all of them, and its mask has none of
them: any two fingerprints within the radius agree in one of the 31 masks, whatever they are. No link is lost, and a mask still has about half
the bits, so unrelated fingerprints hardly meet.

Equal fingerprints are one node. A bucket of up to SMALL fingerprints is compared in blocks inside a task, which returns a spanning forest of
its links, not its pairs. In a larger one each fingerprint is dealt to its midpoints, the fingerprints at most RADIUS / 2 bits off among the bits
that the mask leaves out (497 or 529 of them). Two fingerprints of a bucket are within the radius just if they have a midpoint in common, so all
that meet at a midpoint are linked to their least one, and work grows with the bucket, not with its square. No midpoint has more than 529 guests.

Defined cases: a null text is empty; a text without words has fingerprint 0 and is linked like any other; every row is a document of its own,
rows of one id included; a null id is never a component's id, unless it has no other (null); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import as_bytes, chunks, offsets, stage, table
from orbitframe.llm.neardup import components

WORDS, RADIUS, SEED, SMALL, BLOCK = 4, 4, 42, 1024, 1 << 15


def masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask for each nonzero vector of radius + 1 bits; positions take the nonzero vectors in turn."""
    most = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((i % most + 1) & v).bit_count() % 2) for v in range(1, most + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    import xxhash

    hash_of, words = xxhash.xxh64_intdigest, text.lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.array(list(map(len, words)), np.int64)
    ends = np.cumsum(size + 1) - 1
    first = ends - size
    k = min(WORDS, len(words))
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    for a in range(0, n, BLOCK):  # a very long text block by block
        begin, end = first[a : min(a + BLOCK, n)].tolist(), ends[a + k - 1 : min(a + BLOCK, n) + k - 1].tolist()
        h = np.fromiter((hash_of(joined[x:y], SEED) for x, y in zip(begin, end, strict=True)), np.uint64, len(begin))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = np.array([fingerprint(x) for x in batch["text"].to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "f"])


def forest(values: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect, within each list values[at[i]:at[i + 1]], what pairs within the radius connect: one less than members at most."""
    lists = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left, right = [], []
    for shift in range(1, int(np.diff(at).max(initial=0))):
        i = np.flatnonzero(lists[shift:] == lists[:-shift])
        near = i[np.bitwise_count(values[i] ^ values[i + shift]) <= radius]
        left.append(near)
        right.append(near + shift)
    if not left:
        return values[:0], values[:0]
    a, b, label = np.concatenate(left), np.concatenate(right), np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(label)))
    return values[other], values[label[other]]


def _forests(radius: int, most: int = 1 << 14):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["fs"]
            values, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            start = 0
            while start < len(at) - 1:  # some lists at a time, so that their pairs fit
                end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
                own = at[start : end + 1]
                a, b = forest(values[own[0] : own[-1]], own - own[0], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
                start = end

    return run


def midpoints(members: DataFrame, own: list[int], flips: int) -> DataFrame:
    """(t, f, mid): f with each choice of at most `flips` bits outside mask t turned over, each choice once."""
    free = F.array(*(F.array(*(F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in own))
    rows = members.select("t", "f", F.element_at(free, F.col("t") + 1).alias("free"), F.col("f").alias("mid"), F.lit(0).alias("i"))
    for _ in range(flips):  # no further bit, or one behind the last
        later = F.posexplode(F.concat(F.array(F.lit(0).cast("long")), F.slice("free", F.col("i") + 1, 64))).alias("k", "bit")
        rows = rows.select("t", "f", "free", "mid", "i", later)
        rows = rows.select("t", "f", "free", F.col("mid").bitwiseXOR(F.col("bit")).alias("mid"), F.when(F.col("k") == 0, 64).otherwise(F.col("i") + F.col("k")).alias("i"))
    return rows.select("t", "f", "mid")


def links(prints: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (f) that connect just what pairs within the radius connect; a and b may be ends of a chain of them."""
    own = masks(radius)
    keys = F.array(*(F.col("f").bitwiseAND(F.lit(signed(m))) for m in own))
    dealt = prints.select("f", F.posexplode(keys).alias("t", "key"))
    buckets = stage(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    members = stage(dealt.join(buckets, ["t", "key"]))
    lists = members.where(F.col("n") <= small).groupBy("t", "key").agg(F.collect_list("f").alias("fs"))  # of `small` at most
    found = lists.select("fs").mapInArrow(_forests(radius), "a long, b long")
    large = members.where(F.col("n") > small)
    if large.head(1):
        guests = midpoints(large, own, radius // 2).groupBy("t", "mid").agg(F.collect_list("f").alias("fs"))  # 529 at most
        least = guests.where(F.size("fs") > 1).select(F.array_min("fs").alias("b"), F.explode("fs").alias("a")).where("a != b")
        found = found.unionByName(least.select("a", "b"))
    return found.distinct()


def classes(docs: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(doc_id, f, component_id) of every row."""
    rows = stage(as_bytes(docs).mapInArrow(_prints, "doc_id long, f long"))
    first = rows.groupBy("f").agg(F.min("doc_id").alias("first"))
    joined = links(first.select("f"), radius, small)
    joined = stage(joined)
    nodes = joined.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    comp = components(nodes, joined)
    named = first.join(comp, first.f == comp.node, "left").select("f", "first", F.coalesce("comp", "f").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = named.join(least, "comp").select("f", "component_id")
    return rows.join(named, "f").select("doc_id", "f", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
