"""Language-model scoring with a hashed maximum-entropy model.

The vocabulary is the end of a text and the most frequent words that training texts have twice or more, `branch` to the third targets at most
(21952, a fixed bound of the model's size), in classes and classes of these by frequency; all other words are one more class, which so has the
share that new words have. A target has probability P(class | context) P(inner class | class, context) P(word | inner class, context); the
softmaxes add up weights of hashed features of the context: the word before, the word before that alone (skip) and, for classes, both
together. In contexts a word outside the vocabulary is known by a hash of its first three and last two bytes. A word outside the vocabulary
gets its class's probability times its add-one share among such words.

Biases start at the add-one shares of the training counts; the other weights start at 0 and are trained by distributed gradient updates
over all training documents: in each of `rounds` rounds the tasks take their share of the documents, follow the gradient in small batches
from the common weights on (Adagrad by row, with weight decay) and return what has changed; of each row of the tables the mean change of the tasks
that touched it is added. A task has about `task_tokens` tokens, so what travels is in proportion to the corpus. Scoring gathers the rows of
each batch's features alone.

The base score is the add-one unigram log10 probability under the counts of all training tokens. The vocabulary and its counts are
broadcast; other words of a text are joined to the table of all counts, partitioned by word, so no task or broadcast grows with the number
of distinct words. Words are runs of characters other than space and U+0009 to U+000D with A-Z lower-cased; each text ends with one end,
counted as a token.

Defined cases: a null text is empty and has the end alone; rows with a null id are scored, not learnt from, with held_out null;
repeated rows count each; without training documents every count is 0; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import chunks, fold, lane, mix, offsets, segment_sums, stage, table, total


@dataclass(frozen=True)
class Params:
    branch: int = 28
    table_rows: tuple[int, int, int] = (1 << 13, 1 << 15, 1 << 16)  # powers of two
    affixes: int = 1 << 12
    rounds: int = 3
    task_tokens: int = 4_000_000
    batch: int = 4096
    rate: float = 1.2
    decay: float = 0.002
    seed: int = 3

    @property
    def size(self) -> int:
        """Targets with a place of their own; the first is the end."""
        return self.branch ** len(self.table_rows)


# Code of a token: 0 before the beginning, place + 1 of a target, beyond these a hash of the affixes of any other word.


def _counts(batches):
    seen: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in chunks(batches):
        for text in batch["text"].to_pylist():
            seen.update(text.lower().split())
        if len(seen) > 300_000:
            yield rows()
    yield rows()


def _encode(shared, p: Params):
    """Of each document: its tokens' codes, number of its words in the vocabulary, sum of log10(count + 1) of them, and its other words with counts."""

    def run(batches):
        number, logs = shared.value
        for batch in chunks(batches):
            out = {k: [] for k in ("n_tokens", "n_sure", "sure", "codes", "words", "times")}
            for text in batch["text"].to_pylist():
                words = text.lower().split()
                ids = np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words))
                lost = np.flatnonzero(ids == 0)
                rest = Counter([words[i] for i in lost.tolist()])
                affix = {w: p.size + 1 + zlib.crc32(w[:3] + b"-" + w[-2:]) % p.affixes for w in rest}
                out["n_tokens"].append(len(words) + 1)
                out["n_sure"].append(len(words) - len(lost))
                out["sure"].append(float(logs[ids].sum()))
                ids += 1
                ids[lost] = [affix[words[i]] for i in lost.tolist()]
                out["codes"].append(ids.astype("u2").tobytes())
                out["words"].append(list(rest))
                out["times"].append(list(rest.values()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *(pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True))], names=["doc_id", "held_out", *out])

    return run, "doc_id long, held_out boolean, n_tokens long, n_sure long, sure double, codes binary, words array<binary>, times array<long>"


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each token, ends included, of the one before and of the one before that; where each document's begin."""
    rows = batch["codes"].to_pylist()
    at = offsets([len(r) // 2 + 1 for r in rows])
    end = np.array([1], "u2").tobytes()
    t = np.frombuffer(b"".join(r + end for r in rows), "u2").astype(np.int64)
    one, two = np.concatenate(([0], t[:-1])), np.concatenate(([0, 0], t[:-2]))[: len(t)]
    one[at[:-1]] = two[at[:-1]] = 0
    two[np.minimum(at[:-1] + 1, len(t) - 1)] *= 0
    return t, one, two, at


class Model:
    """Of each level: `w` of hashed features (rows x branches) and biases `b` of the branches (nodes x branches). The root has one branch more, the
    words outside the vocabulary. The branch of a place at each level is a digit of it, to the base `branch`."""

    def __init__(self, p: Params, counts: np.ndarray, other: float):
        """counts: of each target by place; other: of all other words together, each distinct one counted once more."""
        self.p, levels = p, len(p.table_rows)
        share = np.zeros(p.size)
        share[: len(counts)] = counts + 1.0
        self.w = [np.zeros((n, p.branch + (k == 0)), np.float32) for k, n in enumerate(p.table_rows)]
        self.b = []
        for k in range(levels):
            mass = share.reshape(p.branch**k, p.branch, -1).sum(axis=2)
            if k == 0:
                mass = np.append(mass, [[other + 1.0]], axis=1)
            self.b.append(np.log(np.maximum(mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9), 1e-26)).astype(np.float32))

    def nodes(self, t: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that go on at a level, the node in which each is, and its branch."""
        p, own = self.p, np.flatnonzero((t >= 1) & (t <= self.p.size))
        place = (t[own] - 1) // p.branch ** (len(p.table_rows) - 1 - level)
        if level:
            return own, place // p.branch, place % p.branch
        branch = np.full(len(t), p.branch)
        branch[own] = place
        return np.arange(len(t)), np.zeros(len(t), np.int64), branch

    @staticmethod
    def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Hashes of each context's features: the word before, the one before that, both."""
        a, b = one.astype(np.uint64), two.astype(np.uint64)
        return mix(np.stack((a + np.uint64(1 << 20), b + np.uint64(2 << 20), (a << np.uint64(20)) + b + np.uint64(3 << 44))))

    def rows(self, features: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        """Of each feature of each context: its row in the level's table; both words together serve the root alone."""
        if level == 0:
            h = features
        else:
            h = features[:2] + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return (h & np.uint64(self.p.table_rows[level] - 1)).astype(np.uint16 if self.p.table_rows[level] <= 1 << 16 else np.int64)

    def chances(self, level: int, node: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits of the branches, and its sums; weights stay small, so nothing overflows."""
        z = self.b[level].take(node, axis=0)
        for r in rows:
            z += self.w[level].take(r, axis=0)
        np.exp(z, out=z)
        return z, z.sum(axis=1)

    def log_probs(self, t: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log P of each token; of a word outside the vocabulary that of its class."""
        out, features = np.zeros(len(t), np.float32), self.features(one, two)
        for level in range(len(self.w)):
            own, node, branch = self.nodes(t, level)
            e, sums = self.chances(level, node, self.rows(features[:, own], node, level))
            out[own] += np.log(np.maximum(e[np.arange(len(own)), branch], 1e-30) / sums)
        return out

    def learn(self, t: np.ndarray, one: np.ndarray, two: np.ndarray, squares: list[np.ndarray]) -> None:
        """One step on the tokens' log likelihood; squares: of each row the sum of its squared gradients."""
        p, features = self.p, self.features(one, two)
        for level, w in enumerate(self.w):
            own, node, branch = self.nodes(t, level)
            if not len(own):
                continue
            rows = self.rows(features[:, own], node, level)
            g, sums = self.chances(level, node, rows)
            g *= -1 / sums[:, None]
            g[np.arange(len(own)), branch] += 1
            flat = rows.ravel()
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], flat[order[1:]] != flat[order[:-1]])))
            g = segment_sums(g, order % len(g), first)
            r = flat[order[first]]
            have = squares[level][r] + np.einsum("ij,ij->i", g, g)
            squares[level][r] = have
            pace = (p.rate / np.sqrt(have))[:, None]
            g *= pace
            g += w.take(r, axis=0) * (1 - p.decay * pace)
            w[r] = g


ROWS = 256  # rows of a table that travel together


def _changes(shared, p: Params):
    """What a task's documents change in the tables: parts of ROWS rows with their changes and whether they were touched."""

    def run(batches):
        model = pickle.loads(pickle.dumps(shared.value))
        start, squares = [w.copy() for w in model.w], [np.ones(len(w), np.float32) for w in model.w]
        random, seen = np.random.default_rng(p.seed), 0
        for batch in chunks(batches, "codes", budget=1 << 18, rows=2000):
            t, one, two, _ = _sequences(batch)
            order = random.permutation(len(t))
            for s in range(0, len(t), p.batch):
                k = order[s : s + p.batch]
                model.learn(t[k], one[k], two[k], squares)
            seen += len(t)
        part, out = 0, []
        for k, old in enumerate(start):
            touched = squares[k] != 1
            change = np.where(touched[:, None], model.w[k] - old, 0)
            for s in range(0, len(old), ROWS):
                if touched[s : s + ROWS].any():
                    out.append((part, np.concatenate((change[s : s + ROWS].ravel(), touched[s : s + ROWS])).astype("f2").tobytes()))
                part += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([lane()] * len(out), pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["part", "lane", "v"])

    return run, "part int, lane int, v binary"


def train(codes: DataFrame, model: Model, tokens: int) -> Model:
    """Rounds of gradient updates over the documents' codes (row, codes); tokens: how many they have."""
    p, spark = model.p, codes.sparkSession
    tasks = max(1, -(-tokens // (p.task_tokens * p.rounds)))
    for k in range(p.rounds):
        shared = spark.sparkContext.broadcast(model)  # its size is set by Params alone
        own = codes.where(F.pmod(F.xxhash64("row"), F.lit(p.rounds)) == k).select("codes").coalesce(tasks)
        sums = total(own.mapInArrow(*_changes(shared, p)), "f2", "f4")
        part = 0
        for w in model.w:
            for s in range(0, len(w), ROWS):
                if part in sums:
                    change, touched = np.split(sums[part], [w[s : s + ROWS].size])
                    w[s : s + ROWS] = np.clip(w[s : s + ROWS] + change.reshape(-1, w.shape[1]) / np.maximum(touched, 1)[:, None], -8, 8)
                part += 1
    return model


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in chunks(batches, "codes", budget=1 << 18, rows=2000):
            t, one, two, at = _sequences(batch)
            logp = np.concatenate([model.log_probs(t[s : s + 2048], one[s : s + 2048], two[s : s + 2048]) for s in range(0, len(t), 2048)]).astype(np.float64)
            s = np.add.reduceat(logp, at[:-1]) / np.log(10)
            other = np.add.reduceat((t > model.p.size).astype(np.int64), at[:-1])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(s), pa.array(other)], names=["row", "model", "n_other"])

    return run, "row long, model double, n_other long"


def score(docs: DataFrame, held_out: Column, p: Params = Params()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; training rows are those with held_out false."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.select("doc_id", held_out.alias("held_out"), text)
    learn = rows.where(~F.col("held_out"))
    counts = stage(learn.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    ends = learn.count()
    words_total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = words_total + ends, distinct + (ends > 0)
    top = [(bytes(r["word"]), r["n"]) for r in counts.where("n > 1").orderBy(F.desc("n"), "word").limit(p.size - 1).collect()]  # places 1, 2, ...
    logs = np.log10(np.array([0] + [n for _, n in top], np.float64) + 1)
    encode, kind = _encode(spark.sparkContext.broadcast(({w: i + 1 for i, (w, _) in enumerate(top)}, logs)), p)
    coded = stage(rows.mapInArrow(encode, kind).withColumn("row", F.monotonically_increasing_id()))

    left, kinds_left = words_total - sum(n for _, n in top), distinct - len(top)  # of the words without a place
    model = train(coded.where(~F.col("held_out")).select("row", "codes"), Model(p, np.array([ends] + [n for _, n in top], np.float64), left + kinds_left), tokens)
    scored = coded.select("row", "codes").mapInArrow(*_score(spark.sparkContext.broadcast(model)))

    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail"), F.sum("times").alias("n_tail"))
    log_base, log_left = float(np.log10(tokens + kinds + 1)), float(np.log10(left + kinds_left + 1))
    out = coded.drop("codes", "words", "times").join(scored, "row").join(tail, "row", "left")
    end = float(np.log10(ends + 1))
    tail_log, n_tail = F.coalesce("tail", F.lit(0.0)), F.coalesce("n_tail", F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_sure") + n_tail + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sure") + tail_log + F.lit(end) - F.col("n_tokens") * F.lit(log_base)).alias("base_score"),
        (F.col("model") + tail_log - F.col("n_other") * F.lit(log_left)).alias("score"),
    )


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)
