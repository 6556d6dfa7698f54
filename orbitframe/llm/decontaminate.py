"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of `block` words; a passage is two neighbouring blocks. Terms are the words of the benchmark; document
frequencies over all documents give TF-IDF weights. A distributed randomised SVD follows: every task adds its passages' share of A'A Omega,
and the driver turns the sum (terms x sketch) into the leading right singular vectors. Terms in more than `common` of the documents
weigh nothing here, as they tell languages apart and not passages; they count in all that follows. Each passage whose latent vector has a cosine of
`cosine` or more with an item's is a candidate, and so is every stretch of text, whatever its cosine, that holds `loose` of an item's IDF weight:
no other can pass the verification, so neither the cut nor the rank loses a leak. Candidates are verified in place: the longest common subsequence of the item and the words
around the passage must hold `near` of the item's IDF weight, or `loose` of it together with `answer` of its last fifth (the answer), which
lets paraphrases through and keeps look-alikes out.

The text is read once: the numbers of the benchmark's words in each document and the gaps between them are written as a compact table,
and they suffice for all later steps, since no other word can match an item. The benchmark goes through in groups of at most about
`group` items, which bounds everything that is broadcast or brought to the driver.

Defined cases: null texts are empty; items or documents without words match nothing; rows with a null id are left out; of rows with one id
the best match counts; other columns are ignored (clean carries them). A gap of over 65535 words counts as 65535.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import as_bytes, chunks, free, lane, letters, offsets, segment_sums, stage, table, total


@dataclass(frozen=True)
class Params:
    block: int = 20
    dims: int = 256
    sketch: int = 288
    common: float = 0.08
    cosine: float = 0.42
    near: float = 0.75
    loose: float = 0.5
    answer: float = 0.6
    group: int = 4000
    seed: int = 5


def _encode(words: dict[bytes, int], kind: str):
    def run(batches):
        for batch in chunks(batches):
            ids, gaps = [], []
            for text in batch["text"].to_pylist():
                found = letters(text)
                number = np.fromiter((words.get(w, -1) for w in found), np.int64, len(found))
                at = np.flatnonzero(number >= 0)
                ids.append(number[at].astype(kind).tobytes())
                gaps.append(np.minimum(np.diff(at, prepend=0), 65535).astype("u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), pa.array(gaps, pa.binary())], names=["doc_id", "ids", "gaps"])

    return run


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows end to end, and where each row's begin."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), offsets([len(r) // np.dtype(kind).itemsize for r in rows])


def _tokens(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its number, place and document; where each document's begin."""
    ids, at = _flat(batch["ids"], kind)
    gaps, _ = _flat(batch["gaps"], "u2")
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    run = np.cumsum(gaps.astype(np.int64))
    return ids.astype(np.int64), run - np.concatenate(([0], run))[at[:-1]][doc], doc, at


def _blocks(place: np.ndarray, doc: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each block that has tokens: its first token, and its document and number in one code."""
    code = doc * (1 << 40) + place // block
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return first, code[first]


def _count(size: int, kind: str):
    def run(batches):
        df, n = np.zeros(size, np.int64), 0
        for batch in chunks(batches, "ids", budget=1 << 20, rows=2000):
            ids, at = _flat(batch["ids"], kind)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            df += np.bincount(np.unique(doc * size + ids.astype(np.int64)) % size, minlength=size)
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "lane": pa.array([lane()], pa.int32()), "v": pa.array([np.append(df, n).astype("i8").tobytes()], pa.binary())})

    return run


def _sketch(shared, kind: str, p: Params):
    def run(batches):
        weight, omega = shared.value
        weighted, y = omega * weight[:, None], np.zeros(omega.shape, np.float64)
        for batch in chunks(batches, "ids", budget=128 << 10, rows=500):
            ids, place, doc, _ = _tokens(batch, kind)
            own = weight[ids] > 0
            ids = ids[own]
            if not len(ids):
                continue
            first, _ = _blocks(place[own], doc[own], 2 * p.block)
            z = segment_sums(weighted, ids, first)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
            order = np.argsort(ids, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) > 0)))
            y[ids[order][cut]] += segment_sums(z, of[order], cut)
        y *= weight[:, None]
        rows = [(k, y[s : s + 1024]) for k, s in enumerate(range(0, len(y), 1024))]
        yield pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in rows], pa.int32()), "lane": pa.array([lane()] * len(rows), pa.int32()), "v": pa.array([v.astype("f4").tobytes() for _, v in rows], pa.binary())})

    return run


def basis(y: np.ndarray, omega: np.ndarray, dims: int) -> np.ndarray:
    """Leading eigenvectors of A'A from the sketch y = A'A omega (Nystrom)."""
    core = (omega.T @ y + y.T @ omega) / 2
    values, vectors = np.linalg.eigh(core)
    good = values > max(values.max(), 0) * 1e-6
    if not good.any():
        return np.zeros((len(y), 1))
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :dims]


def common_weight(item: np.ndarray, words: np.ndarray, idf: np.ndarray) -> float:
    """Weight of the heaviest common subsequence."""
    row = np.zeros(len(words) + 1)
    for term in item:
        row[1:] = np.maximum(row[1:], np.where(words == term, row[:-1] + idf[term], 0))
        np.maximum.accumulate(row, out=row)
    return float(row[-1])


def rarest(items: list[tuple[int, np.ndarray]], idf: np.ndarray, loose: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of each item's rarest words, ascending by word: where each word's begin, the items, the weights; and the weight of these words
    that a text must have for `loose` of the item's weight, if it has all other words. The others hold at most half of `loose`."""
    word, item, weight, least = [], [], [], np.zeros(len(items))
    for i, (_, x) in enumerate(items):
        w, n = np.unique(x, return_counts=True)
        order = np.argsort(-idf[w], kind="stable")
        w, v = w[order], (n * idf[w])[order].astype(np.float64)
        left = v.sum() - np.cumsum(v)
        k = int(np.argmax(left <= loose / 2 * v.sum())) + 1
        word.append(w[:k]), item.append(np.full(k, i)), weight.append(v[:k])
        least[i] = (loose * v.sum() - left[k - 1]) * (1 - 1e-5)
    word, item, weight = np.concatenate(word), np.concatenate(item), np.concatenate(weight)
    order = np.argsort(word, kind="stable")
    return np.searchsorted(word[order], np.arange(len(idf) + 1)), item[order], weight[order], least


def stretches(ids: np.ndarray, place: np.ndarray, doc: np.ndarray, index, size: int, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (document and number in one code) of `length` words and `reach` beyond, and the items whose rarest words they hold enough of."""
    at, item, weight, least = index
    own = np.flatnonzero(at[ids + 1] > at[ids])
    ids, place, doc = ids[own], place[own], doc[own]
    number = place // length
    early = np.flatnonzero((number > 0) & (place - number * length < reach))
    code = np.concatenate((doc * (1 << 40) + number, doc[early] * (1 << 40) + number[early] - 1))
    names, code = np.unique(code, return_inverse=True)
    both = np.unique(code * size + np.concatenate((ids, ids[early])))  # each word of a stretch once
    code, ids = both // size, both % size
    n = at[ids + 1] - at[ids]
    spot = np.repeat(at[ids] - offsets(n)[:-1], n) + np.arange(n.sum())
    key = np.repeat(code, n) * len(least) + item[spot]
    held = np.bincount(key, weight[spot], minlength=len(names) * len(least)).reshape(len(names), len(least))
    found, which = np.nonzero((held >= least) & (held > 0))
    return names[found], which


def _search(shared, kind: str, p: Params):
    def run(batches):
        idf, latent, items, vectors = shared.value
        index = rarest(items, idf, p.loose)
        reach = 2 * p.block + 2 * max(len(x) for _, x in items)
        length = max(256, reach)
        names, mass = np.array([i for i, _ in items]), np.array([idf[x].sum() for _, x in items])
        bags = [dict(enumerate(np.bincount(x) * idf[: x.max() + 1])) for _, x in items]
        bags = [{t: float(v) for t, v in bag.items() if v} for bag in bags]
        for batch in chunks(batches, "ids", budget=128 << 10, rows=500):
            out = {"doc_id": [], "item_id": [], "cosine": [], "overlap": [], "answer": []}
            ids, place, doc, at = _tokens(batch, kind)
            hits: dict[tuple[int, int], set[int]] = {}
            own = np.flatnonzero(latent[ids, 0] != 0)
            z, of = np.zeros((0, latent.shape[1])), np.zeros(0, np.int64)
            if len(own):
                first, code = _blocks(place[own], doc[own], p.block)
                z, of = segment_sums(latent, ids[own], first), code >> 40
                z[:-1] += z[1:] * (code[1:] == code[:-1] + 1)[:, None]
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                for s in range(0, len(z), 4096):
                    cos = z[s : s + 4096] @ vectors.T
                    for k, i in zip(*(x.tolist() for x in np.nonzero(cos >= p.cosine)), strict=True):
                        hits.setdefault((int(of[s + k]), i), set()).add(int(code[s + k] & ((1 << 40) - 1)))
            _, code = _blocks(place, doc, p.block)
            edge = np.searchsorted(code >> 40, np.arange(batch.num_rows + 1))
            for name, i in zip(*(x.tolist() for x in stretches(ids, place, doc, index, len(idf), length, reach)), strict=True):
                d, n = name >> 40, name & ((1 << 40) - 1)
                lo, hi = np.searchsorted(place[at[d] : at[d + 1]], (n * length, n * length + length + reach))
                if sum(map(bags[i].__getitem__, bags[i].keys() & set(ids[at[d] + lo : at[d] + hi].tolist()))) < p.loose * mass[i] * (1 - 1e-5):
                    continue
                k = code[edge[d] : edge[d + 1]] & ((1 << 40) - 1)
                hits.setdefault((d, i), set()).update(k[np.maximum(k * p.block - len(items[i][1]), 0) // length == n].tolist())
            for (d, i), found in hits.items():
                item, spot = items[i][1], place[at[d] : at[d + 1]]
                words, best, end = ids[at[d] : at[d + 1]], (False, 0.0, 0.0), None
                for k in sorted(found):
                    lo, hi = np.searchsorted(spot, (k * p.block - len(item), (k + 2) * p.block + len(item)))
                    if (lo, hi) == end:
                        continue
                    end, near = (lo, hi), words[lo:hi]
                    if sum(map(bags[i].__getitem__, bags[i].keys() & set(near.tolist()))) < p.loose * mass[i]:
                        continue  # the shared terms bound what any subsequence shares
                    tail = item[-max(3, len(item) // 5) :]
                    overlap, answer = common_weight(item, near, idf) / mass[i], common_weight(tail, near, idf) / max(idf[tail].sum(), 1e-9)
                    best = max(best, (overlap >= p.near or overlap >= p.loose and answer >= p.answer, overlap, answer))
                if best[0]:
                    cosine = float((z[of == d] @ vectors[i]).max(initial=0))
                    for name, v in zip(out, (batch["doc_id"][d].as_py(), int(names[i]), cosine, *best[1:]), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["item_id"], pa.int64()), *(pa.array(out[k], pa.float64()) for k in ("cosine", "overlap", "answer"))], names=list(out))

    return run


def _leaks(docs: DataFrame, items: list[tuple[int, list[bytes]]], p: Params) -> DataFrame:
    spark = docs.sparkSession
    words = {w: k for k, w in enumerate(sorted({w for _, x in items for w in x}))}
    kind, size = "u2" if len(words) < 65536 else "u4", len(words)
    numbers = [(i, np.array([words[w] for w in x])) for i, x in items]
    compact = stage(as_bytes(docs.where("doc_id is not null")).mapInArrow(_encode(words, kind), "doc_id long, ids binary, gaps binary"))
    rows = "part int, lane int, v binary"
    df = total(compact.mapInArrow(_count(size, kind), rows), "i8").get(0, np.zeros(size + 1))
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.05).astype(np.float32)
    weight = np.where(df[:-1] <= p.common * df[-1], idf, 0).astype(np.float32)
    omega = np.random.default_rng(p.seed).normal(size=(size, min(p.sketch, size))).astype(np.float32)
    sums = total(compact.mapInArrow(_sketch(spark.sparkContext.broadcast((weight, omega)), kind, p), rows))
    y = np.concatenate([sums[k] for k in sorted(sums)]).reshape(omega.shape).astype(np.float64) if sums else np.zeros(omega.shape)
    latent = (basis(y, omega, p.dims) * weight[:, None]).astype(np.float32)
    vectors = np.stack([latent[x].sum(axis=0) for _, x in numbers])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    shared = spark.sparkContext.broadcast((idf, latent, numbers, vectors))  # at most `group` items and their words
    return compact.mapInArrow(_search(shared, kind, p), "doc_id long, item_id long, cosine double, overlap double, answer double")


def leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer) of the documents that hold a benchmark item, and of the items."""
    bench = benchmark.where("item_id is not null and text is not null")
    groups = max(1, -(-bench.count() // p.group))
    out = None
    for g in range(groups):
        own = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).select("item_id", F.col("text").cast("binary").alias("text"))
        items = sorted((r["item_id"], words) for r in own.collect() if (words := letters(bytes(r["text"]))))
        if items:
            found = _leaks(docs, items, p)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, overlap double, answer double")
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"), F.max("answer").alias("answer"))


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    (own,) = free(docs.columns, "__id")
    found = leaks(docs, benchmark, p).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(own), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
