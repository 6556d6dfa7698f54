"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, runs of three byte classes (small letter, capital, digit, each kind of sign, ...) and how much a text repeats
itself, so that both what a text says and what it looks like count. A bounded sample of labelled rows (`max_per_class` of each class, each of at most `max_train_chars`
characters, chosen by a hash of the id) gives the inverse document frequencies, a truncated SVD and the labelled latent vectors, at most
2 * max_per_class of them, which are broadcast. Every document is projected whole; its exact cosines with all labelled vectors come from
blocked matrix products, and the nearest `neighbours` vote with their similarity, weighted so that the classes count as in all labels.

Defined cases: a null text is empty; a text without terms gets the share of label 1; labels that are null are left out, of several labels of
one id the largest counts; repeated rows are scored each; a table without labels of both classes gives every text the share of label 1
(0 if there are none). Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import WordHash, as_bytes, chunks, fold, letters, offsets, one_row, table


@dataclass(frozen=True)
class Params:
    word_bits: int = 12
    dims: int = 64
    neighbours: int = 15
    max_per_class: int = 1500
    max_train_chars: int = 30_000
    shares: tuple[float, float, float] = (0.2, 0.5, 0.3)
    seed: int = 11


def _classes() -> np.ndarray:
    """A class of 0 to 15 for each byte."""
    out = np.full(256, 15, np.uint8)  # bytes of non-ASCII characters
    out[:32], out[127] = 14, 14
    for k, signs in enumerate((b" ", b"\n", b".", b",;:", b"!?", b"|", b"#*", b"$%&", b"'\"`", b"()[]{}<>", b"/\\_=+-~^@")):
        out[np.frombuffer(signs, np.uint8)] = k
    out[48:58], out[65:91], out[97:123] = 11, 12, 13
    return out


CLASSES = _classes()
SHAPES = 16**3
#: Terms for how much a text repeats itself: eighths of distinct words among its words, of words that equal the one before, log4 of its length.
HABITS = 24


def features(texts: list[bytes], cache: WordHash, p: Params) -> np.ndarray:
    """Counts of every term (words first, then shapes, then habits) in each text."""
    n, words = len(texts), [letters(t) for t in texts]
    vocabulary = 1 << p.word_bits
    lengths = [len(w) for w in words]
    h, of = cache.of([x for one in words for x in one]), np.repeat(np.arange(n), lengths)
    ids = (h & np.uint64(vocabulary - 1)).astype(np.int64) + of * vocabulary
    out = np.zeros((n, vocabulary + SHAPES + HABITS), np.float32)
    out[:, :vocabulary] = np.bincount(ids, minlength=n * vocabulary).reshape(n, vocabulary)
    for i, t in enumerate(texts):
        c = CLASSES[np.frombuffer(t, np.uint8)].astype(np.int32)
        out[i, vocabulary:-HABITS] = np.bincount((c[:-2] * 16 + c[1:-1]) * 16 + c[2:], minlength=SHAPES) if len(c) > 2 else 0
    same = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
    for i in np.flatnonzero(lengths):
        m = lengths[i]
        for k, share in enumerate((len(set(words[i])) / m, same[i] / m, np.log(m) / np.log(4) / 8)):
            out[i, vocabulary + SHAPES + 8 * k + min(7, int(8 * share))] = 1
    return out


def weigh(counts: np.ndarray, idf: np.ndarray, p: Params) -> np.ndarray:
    """log(1 + count) times idf; words, shapes and habits have fixed shares of the squared length."""
    x, words = np.log1p(counts, out=counts), 1 << p.word_bits
    x *= idf
    for part, share in zip((x[:, :words], x[:, words:-HABITS], x[:, -HABITS:]), p.shares, strict=True):
        part *= np.sqrt(share) / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def svd_basis(x: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The leading right singular vectors of x, by a randomised range finder with power iterations."""
    q = np.random.default_rng(seed).normal(size=(x.shape[1], min(dims + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    values, vectors = np.linalg.eigh((y := x @ q).T @ y)
    return (q @ vectors[:, ::-1][:, :dims]).astype(np.float32)


@dataclass
class Model:
    params: Params
    prior: float
    idf: np.ndarray | None = None
    basis: np.ndarray | None = None
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None
    weights: np.ndarray | None = None

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = weigh(counts, self.idf, self.params) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes], cache: WordHash) -> np.ndarray:
        counts = features(texts, cache, self.params)
        bare = counts.sum(axis=1) == 0
        cos = self.project(counts) @ self.vectors.T
        k = min(self.params.neighbours, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        # the gap to the best neighbours counts: similarity to a high power, times the class's weight
        vote = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-3).astype(np.float64) ** 8 * self.weights[near]
        out = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        return np.where(bare, self.prior, out)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, p: Params = Params()) -> Model:
    """Fit on labelled rows for which `keep` holds."""
    have = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & keep).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in have.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = [have.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_per_class) for y in (0, 1)]
    # at most 2 * max_per_class ids: a proven bound for the broadcast, and with max_train_chars for what comes to the driver
    near = docs.where(F.length("text") <= p.max_train_chars).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = one_row(near.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["text"])))
    y = np.array([r["y"] for r in rows], np.float64)
    if len(rows) < 4 or not 0 < y.sum() < len(y):
        return Model(p, prior)
    cache = WordHash()
    x = np.concatenate([features([bytes(r["text"]) for r in rows[s : s + 256]], cache, p) for s in range(0, len(rows), 256)])
    idf = np.log((len(rows) + 1) / ((x > 0).sum(axis=0) + 1)).astype(np.float32) + np.float32(0.1)
    x = weigh(x, idf, p)
    basis = svd_basis(x, p.dims, p.seed)
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    weights = np.where(y == 1, prior * len(y) / y.sum(), (1 - prior) * len(y) / (len(y) - y.sum()))
    return Model(p, prior, idf, basis, z.astype(np.float32), y, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document, from its whole text."""
    if model.vectors is None:
        return docs.select("doc_id", F.lit(float(model.prior)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, set by Params alone

    def run(batches):
        m, cache = shared.value, WordHash()
        for batch in chunks(batches, rows=256):
            s = m.scores(batch["text"].to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64())], names=["doc_id", "score"])

    return as_bytes(docs).mapInArrow(run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
