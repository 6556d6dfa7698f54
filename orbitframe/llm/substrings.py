"""Removal of word sequences that an earlier document already holds, by level-wise doubling.

Windows of `length` words are wanted. The first level looks at windows of length / 2^k words (25 for 50), and only at those that winnowing
picks: the least hash of every run of them that a window of the next level spans, so two documents that share such a window pick the same
ones. Those that stand in two documents alone are extended: at twice the length every window that holds a survivor is looked up again, and
so on, until no candidates survive or the wanted length is reached (a longer repeat is a union of such windows). The windows' first holders
come from a min() per hash with map-side combining and a join that Spark can split, so a passage in a third of all documents is no hot spot.
Texts that are equal word for word are told by their hash: only the smallest id of each takes part in the levels.

Words are runs of characters other than space and U+0009 to U+000D, unchanged. Hashes have 96 bits.

Defined cases: a null text has no words; a document shorter than a window loses nothing; rows with a null id neither lose words nor make
others lose them; rows of one id never make each other lose words, equal rows lose the same words; all columns but doc_id and text are
ignored here and carried by remove_repeats.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import WordHash, chunks, discard, free, offsets, stage, starts, table, windows

SECOND_BASE = 0xD1342543DE82EF95
KEY = ["doc_id", "t"]


def levels(length: int, least: int = 20) -> list[int]:
    """Window lengths by level, each twice the one before and the last one `length`, from `least` words or a little more."""
    out = [length]
    while out[0] % 2 == 0 and out[0] // 2 >= least:
        out.insert(0, out[0] // 2)
    return out


def winnow(h: np.ndarray, span: int) -> np.ndarray:
    """Positions of the least hash in each run of `span` hashes."""
    if len(h) < span:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(h, span)
    return np.unique(np.argmin(runs, axis=1) + np.arange(len(runs)))


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))


def _scan(sizes: list[int]):
    """Of each document: number of words, digest of all its words, and the picked windows of the first level."""
    first, length = sizes[0], sizes[-1]
    after = sizes[min(1, len(sizes) - 1)]

    def run(batches):
        cache = WordHash()
        for batch in chunks(batches):
            words = [x.split() for x in batch["text"].to_pylist()]
            joined = [b" ".join(w) for w in words]
            lengths = np.array([len(w) for w in words])
            long = np.flatnonzero(lengths >= length)
            at = [np.zeros(0, np.int64)] * len(words)
            hashes = [np.zeros(0, np.uint64)] * len(words)
            if len(long):
                h = cache.of([x for i in long for x in words[i]])
                pos, doc = starts(lengths[long], first)
                grams = windows(h, first)[pos]
                picked = winnow(grams, after - first + 1)
                of, begin = doc[picked], offsets(lengths[long])[:-1]
                cut = np.searchsorted(of, np.arange(len(long) + 1))
                for k, i in enumerate(long):
                    mine = picked[cut[k] : cut[k + 1]]
                    at[i], hashes[i] = pos[mine] - begin[k], grams[mine]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["t"], pa.array(lengths, pa.int64()), pa.array([hashlib.sha256(x).digest() for x in joined], pa.binary()), _lists(hashes, np.int64, pa.int64()), _lists(at, np.int32, pa.int32())],
                names=["doc_id", "t", "n_words", "sha", "hashes", "at"],
            )

    return run, "doc_id long, t long, n_words long, sha binary, hashes array<long>, at array<int>"


def _lists(parts: list[np.ndarray], dtype, kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0)
    flat = flat.view(dtype) if flat.dtype.itemsize == np.dtype(dtype).itemsize else flat.astype(dtype)
    return pa.ListArray.from_arrays(pa.array(offsets([len(x) for x in parts]), pa.int32()), pa.array(flat, kind))


def _pack(batches):
    packer = zstandard.ZstdCompressor(level=1)
    for batch in chunks(batches):
        z = [packer.compress(b" ".join(x.split())) for x in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["t"], pa.array(z, pa.binary())], names=["doc_id", "t", "z"])


def _candidates(size: int, inner: int, first: bool):
    """Rows (h, g, doc_id, t, at) of the windows of `size` words that may be repeated: at the first doubling those that hold a surviving
    window of `inner` words, later those whose halves both survive."""

    def run(batches):
        cache, unpack = WordHash(), zstandard.ZstdDecompressor()
        for batch in chunks(batches, "z", budget=1 << 20, rows=128):
            words = [unpack.decompress(z).split() for z in batch["z"].to_pylist()]
            lengths = np.array([len(w) for w in words])
            h = cache.of([x for w in words for x in w])
            pos, doc = starts(lengths, size)
            if not len(pos):
                continue
            begin, live = offsets(lengths), np.zeros(len(h) + 1, np.int64)
            survivors = batch["at"]
            flat = survivors.flatten().to_numpy() + np.repeat(begin[:-1], np.diff(survivors.offsets.to_numpy()))
            if first:
                np.add.at(live, np.maximum(flat - (size - inner), 0), 1)
                np.add.at(live, flat + 1, -1)
                pick = np.cumsum(live)[pos] > 0
            else:
                live[flat] = 1
                pick = (live[pos] > 0) & (live[pos + inner] > 0)
            pos, doc = pos[pick], doc[pick]
            g = windows(h, size, SECOND_BASE)[pos].astype(np.uint32).view(np.int32)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows(h, size)[pos].view(np.int64)), pa.array(g), batch["doc_id"].take(take), batch["t"].take(take), pa.array((pos - begin[doc]).astype(np.int32))], names=["h", "g", "doc_id", "t", "at"]
            )

    return run, "h long, g int, doc_id long, t long, at int"


def _strip(length: int):
    """What is left of each document without the words of the given windows."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in chunks(batches, "z", budget=1 << 20, rows=128):
            removed, kept = [], []
            for z, at in zip(batch["z"].to_pylist(), batch["at"].to_pylist(), strict=True):
                words = unpack.decompress(z).split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.array(at)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]).decode())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["t"], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "t", "n_removed", "kept"])

    return run, "doc_id long, t long, n_removed long, kept string"


def repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, t, n_words, n_removed, kept_sha256, kept) of every row: t is xxhash64 of the text, kept what is left of a text that loses words."""
    sizes = levels(length)
    keyed = _with_key(docs)
    scan, kind = _scan(sizes)
    seen = stage(keyed.mapInArrow(scan, kind))
    whole = seen.where((F.col("n_words") >= length) & F.col("doc_id").isNotNull())
    firsts = whole.groupBy("sha").agg(F.min("doc_id").alias("rep"))
    seen = seen.drop("hashes", "at")
    copies = whole.select("sha", *KEY).distinct().join(firsts, "sha")
    copies, own = copies.where(F.col("doc_id") > F.col("rep")).select(*KEY), copies.where(F.col("doc_id") == F.col("rep")).select(*KEY)

    picked = whole.join(own, KEY).dropDuplicates(KEY).select(*KEY, F.explode(F.arrays_zip("hashes", "at")).alias("w")).select(*KEY, F.col("w.hashes").alias("h"), F.col("w.at").alias("at"))
    # as a table of its own, so that the join below reads plain shuffles, whose large partitions Spark splits
    twice = stage(picked.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"))
    alive = picked.join(twice, "h").groupBy(*KEY).agg(F.collect_list("at").alias("at"))
    # only documents with a survivor are read on; their words travel compressed
    texts = stage(keyed.mapInArrow(_pack, "doc_id long, t long, z binary").dropDuplicates(KEY).join(alive, KEY))
    discard(twice)

    inner, lost = sizes[0], None
    for k, size in enumerate(sizes[1:] or sizes):
        run, kind = _candidates(size, inner, k == 0)
        found = texts.mapInArrow(run, kind)
        held = stage(found.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
        found = found.join(held, ["h", "g"])
        if size == length:
            lost = found.where(F.col("doc_id") > F.col("first")).groupBy(*KEY).agg(F.collect_list("at").alias("at"))
        else:
            alive = found.groupBy(*KEY).agg(F.collect_list("at").alias("at"))
            before, texts = texts, stage(texts.drop("at").join(alive, KEY))
            discard(before, held)
        inner = size
    strip, kind = _strip(length)
    left = texts.drop("at").join(lost, KEY).mapInArrow(strip, kind)
    changed = left.unionByName(copies.select(*KEY, F.lit(None).cast("long").alias("n_removed"), F.lit("").alias("kept")))
    return seen.join(changed, KEY, "left").select(
        *KEY,
        "n_words",
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", "n_words")).cast("long").alias("n_removed"),
        F.when(F.col("kept").isNull(), F.lower(F.hex("sha"))).otherwise(F.sha2("kept", 256)).alias("kept_sha256"),
        "kept",
    )


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents without repeated passages, with all their columns: a text that loses words becomes its other words joined by one space,
    and n_chars, where there is one, its new length. Every row stays, even if no word is left; other texts stay as they are."""
    own, t, kept = free(docs.columns, "__id", "__t", "__kept")
    found = repeats(docs, length).where(F.col("kept").isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(KEY, (own, t), strict=True)), F.col("kept").alias(kept)).dropDuplicates([own, t])
    key = (F.col("doc_id") == F.col(own)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(t))
    out = docs.join(found, key, "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        kind = reduce(lambda a, b: b, (f.dataType for f in docs.schema if f.name == "n_chars"))
        out = out.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
