"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed rows for the whole word and for its first 3 to 7 characters, so that inflected forms of a stem are
alike and a single collision means little. Filters one, two and
three words wide slide over the whole text; the largest answer of each filter (max pooling) feeds a logistic output. The fit takes every
labelled row, whole: three quarters (by a hash of the id) train the network, the others set the thresholds. Rows are dealt to at most `shards`
tasks; in each round a task learns from the rows it reads, a few MB at a time, from the common weights, and what the tasks have learnt is
averaged (iterative parameter mixing) by tasks, a block of the table each. What a task holds and what comes to the driver depend on the network's size
alone, and not on the number of shards. Every row is scored whole.

The language whose threshold applies is told from the text by its function words, never from a column. Scores are shifted so
that 0.3 is the calibrated threshold in each language.

Defined cases: a null text is empty; an empty text scores as a text in which no filter answers; labels that are null are left out, of
several labels of one id the largest counts; repeated rows are scored each; a table without labels of both classes gives every text the
share of label 1 (0 if there are none). Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import as_bytes, chunks, discard, fold, letters, offsets, one_row, stage, table

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for it with as on be at by this are from or have an they which you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three",
    "de": "der die und das den ist von zu mit auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "fr": "le la les des et en un une du est pour que qui dans par sur au pas plus ce il ne se avec son sont aux ou mais comme cette ses leur nous vous été elle être même tout fait ces sans",
    "es": "el los las de y que en un una por con para su del se no al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante",
}
LANGS = tuple(FUNCTION_WORDS)


@dataclass(frozen=True)
class Params:
    hash_bits: int = 18
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 8
    rounds: int = 4
    shards: int = 32
    shard_rows: int = 4000
    batch_words: int = 131072
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


def rows_of(word: bytes, bits: int) -> list[int]:
    """Rows of the hashed table that make up a word: the whole word and its first 3 to 7 characters."""
    mask, text = (1 << bits) - 1, word.decode(errors="ignore")
    whole = zlib.crc32(b"=" + word) & mask
    return [whole] + [zlib.crc32(text[:n].encode(), n) & mask if len(text) > n else whole for n in range(3, 8)]


#: The table of CRC-32 by byte, as zlib has it.
CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def table_rows(words: list[bytes], bits: int) -> np.ndarray:
    """rows_of each word; the beginnings of ASCII words, which need no decoding, are hashed together."""
    out = np.empty((len(words), 6), np.int32)
    mask = np.uint32((1 << bits) - 1)
    whole = np.fromiter(map(zlib.crc32, words, repeat(zlib.crc32(b"="))), np.uint32, len(words)) & mask
    size = np.fromiter(map(len, words), np.int32, len(words))
    first = np.array(words, "S8").view(np.uint8).reshape(-1, 8)  # eight ASCII bytes are more characters than any beginning has
    out[:, 0] = whole
    for n in range(3, 8):
        crc = np.full(len(words), n ^ 0xFFFFFFFF, np.uint32)
        for k in range(n):
            crc = CRC[(crc ^ first[:, k]) & 0xFF] ^ (crc >> np.uint32(8))
        out[:, n - 2] = np.where(size > n, ~crc & mask, whole)
    for i in np.flatnonzero((first >= 128).any(axis=1)).tolist():
        out[i] = rows_of(words[i], bits)
    return out


class Numbers(dict):
    """A number for each word, as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Vocabulary:
    """Numbers words as they come, with their table rows; forgets all of them at a bound."""

    def __init__(self, bits: int, limit: int = 150_000):
        self.bits, self.limit = bits, limit
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.rows = np.zeros((0, 6), np.int32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def fresh(self) -> list[bytes]:
        """The words that came since the last call, whose table rows are looked up together."""
        words = list(islice(self.number, len(self.rows), None))
        if words:
            self.rows = np.concatenate((self.rows, table_rows(words, self.bits)))
        return words


#: By function word: in which languages it is one.
VOTES: dict[bytes, int] = {}
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        VOTES[_w.encode()] = VOTES.get(_w.encode(), 0) | 1 << _k


def votes_of(words: list[bytes]) -> np.ndarray:
    """By word: in which languages it is a function word."""
    bits = np.fromiter(map(VOTES.get, words, repeat(0)), np.uint8, len(words))
    return (bits[:, None] >> np.arange(len(LANGS), dtype=np.uint8) & 1).astype(np.float32)


def _language(ids: np.ndarray, at: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Most voted language of each text; the first one if there are no votes."""
    sums = np.concatenate((np.zeros((1, votes.shape[1])), np.cumsum(votes[ids], axis=0, dtype=np.float64)))
    return np.argmax(sums[at[1:]] - sums[at[:-1]], axis=1)


class Network:
    """The hashed table, filters by width and position, biases, output weights."""

    def __init__(self, p: Params):
        r = np.random.default_rng(p.seed)
        self.p = p
        self.w = {"e": r.normal(0, 0.03, (1 << p.hash_bits, p.dims))}
        for width in p.widths:
            self.w[f"f{width}"] = r.normal(0, 0.2, (width, p.dims, p.filters))
            self.w[f"b{width}"] = np.full(p.filters, -0.5)
        self.w["out"] = r.normal(0.3, 0.05, len(p.widths) * p.filters)
        self.w["bias"] = np.array([-2.0])
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def embed(self, rows: np.ndarray) -> np.ndarray:
        x = self.w["e"].take(rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            x += self.w["e"].take(rows[:, k], axis=0)
        return x

    def answers(self, x: np.ndarray) -> list[list[np.ndarray]]:
        """Of each filter position to each of the embeddings x."""
        return [[x @ self.w[f"f{n}"][j] for j in range(n)] for n in self.p.widths]

    def pooled(self, ids: np.ndarray, at: np.ndarray, answers: list[list[np.ndarray]]) -> np.ndarray:
        """Largest answer of each filter in each text, 0 at least; a text shorter than a filter answers it with the words it has."""
        out = np.zeros((len(at) - 1, len(self.p.widths) * self.p.filters), np.float32)
        if not len(ids):
            return out
        full = np.flatnonzero(at[1:] > at[:-1])
        for k, (n, parts) in enumerate(zip(self.p.widths, answers, strict=True)):
            y = parts[0][ids]
            for j in range(1, n):
                part = parts[j][ids[j:]]
                for back in range(1, j + 1):  # a window does not reach into the next text
                    last = at[1:] - back
                    part[last[(last >= at[:-1]) & (last < len(part))]] = 0
                y[: len(part)] += part
            out[full, k * self.p.filters : (k + 1) * self.p.filters] = np.maximum(np.maximum.reduceat(y, at[full], axis=0) + self.w[f"b{n}"], 0)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.w["out"] + self.w["bias"]

    def start(self, df: np.ndarray, texts: np.ndarray) -> None:
        """Where learning starts: a row's log odds of standing in a text of label 1, which all filters listen to. By label: in how many texts each row
        stands, and how many texts there are."""
        p, w = self.p, self.w
        odds = np.log((df[1] + 0.5) / (texts[1] + 1)) - np.log((df[0] + 0.5) / (texts[0] + 1))
        w["e"][:, 0] = 0.2 * np.clip(odds, -5, 5) * np.minimum(1, df.sum(0) / 8)
        for n in p.widths:
            w[f"f{n}"][0, 0, :] += 0.7
            w[f"f{n}"][1:, 0, :] += 0.3

    def begin(self) -> None:
        """Moments of Adam and squares of Adagrad before the first step."""
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items() if k != "e"}
        self.squares, self.step = np.zeros_like(self.w["e"]), 0

    def _batches(self, order: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """At most `batch` texts and, but for a longer single text, `batch_words` words at a time; texts without words are left out."""
        order = order[at[order + 1] > at[order]]
        for s in range(0, len(order), self.p.batch):
            pick = order[s : s + self.p.batch]
            group = np.cumsum(at[pick + 1] - at[pick]) // self.p.batch_words
            yield from np.split(pick, np.flatnonzero(np.diff(group)) + 1)

    def fit(self, ids: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, epochs: int, r: np.random.Generator) -> np.ndarray:
        """Adam on the logistic loss; only the words that won a filter's maximum get a gradient, and table rows learn as in Adagrad. Goes on from what has
        been learnt; returns the table rows that changed."""
        p, w, m, squares = self.p, self.w, self.m, self.squares
        changed = np.zeros(len(squares), bool)
        for _ in range(epochs):
            for pick in self._batches(r.permutation(len(y)), at):
                lengths = at[pick + 1] - at[pick]
                here = offsets(lengths)
                words = ids[np.arange(here[-1]) - here[:-1].repeat(lengths) + at[pick].repeat(lengths)]
                own, back = np.unique(words, return_inverse=True)
                x = self.embed(rows[own])[back]
                end = here[1:].repeat(lengths) - np.arange(here[-1])  # words left in the text, this one included
                wins, parts = [], []
                for n in p.widths:
                    z = x @ w[f"f{n}"][0]
                    for j in range(1, n):
                        z[:-j] += (x[j:] @ w[f"f{n}"][j]) * (end[:-j] > j)[:, None]
                    best = np.maximum.reduceat(z, here[:-1], axis=0)
                    first = np.where(z == np.repeat(best, lengths, axis=0), np.arange(len(z), dtype=np.int32)[:, None], np.int32(len(z)))
                    wins.append(np.minimum.reduceat(first, here[:-1], axis=0))
                    parts.append(np.maximum(best + w[f"b{n}"], 0))
                pooled = np.concatenate(parts, axis=1)
                q = 1 / (1 + np.exp(-(pooled @ w["out"] + w["bias"])))
                d = ((q - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                g, hits = {"out": pooled.T @ d, "bias": np.array([d.sum()])}, []
                for k, n in enumerate(p.widths):
                    dz = np.outer(d, w["out"][k * p.filters : (k + 1) * p.filters]) * (parts[k] > 0)
                    g[f"b{n}"], g[f"f{n}"] = dz.sum(0), np.zeros_like(w[f"f{n}"])
                    for j in range(n):
                        pos = np.minimum(wins[k] + j, len(x) - 1)
                        live = dz * (end[wins[k]] > j)
                        g[f"f{n}"][j] = np.einsum("dfe,df->ef", x[pos], live)
                        hits.append((words[pos].ravel(), (live[:, :, None] * w[f"f{n}"][j].T[None]).reshape(-1, p.dims)))
                self.step += 1
                fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
                for name, grad in g.items():
                    m1, m2 = m[name]
                    m1 += 0.1 * (grad - m1)
                    m2 += 0.001 * (grad * grad - m2)
                    w[name] -= (p.rate * fix * m1 / (np.sqrt(m2) + 1e-8)).astype(np.float32)
                touched, inverse = np.unique(rows[np.concatenate([h[0] for h in hits])], return_inverse=True)
                grad = np.zeros((len(touched), p.dims), np.float32)
                np.add.at(grad, inverse.ravel(), np.repeat(np.concatenate([h[1] for h in hits]), rows.shape[1], axis=0))
                squares[touched] += grad * grad
                w["e"][touched] -= 0.2 * p.rate * grad / (np.sqrt(squares[touched]) + 1e-4)
                changed[touched] = True
        return changed

    def small(self) -> np.ndarray:
        """All but the table and its squares, end to end: weights and both moments of each."""
        return np.concatenate([v.ravel() for k, (a, b) in self.m.items() for v in (self.w[k], a, b)]).astype("<f8")

    def take(self, small: np.ndarray) -> None:
        """The reverse of small()."""
        parts = iter(np.split(small, np.cumsum([self.w[k].size for k in self.m for _ in range(3)])[:-1]))
        for k in self.m:
            shape = self.w[k].shape
            self.w[k], *moments = (next(parts).reshape(shape).astype(np.float32) for _ in range(3))
            self.m[k] = tuple(moments)


#: The largest answer that thresholds tell apart, and in how many steps each unit of them.
LIMIT, STEPS = 64, 1024


@dataclass
class Model:
    network: Network | None
    shift: np.ndarray
    prior: float

    def scores(self, texts: list[bytes], seen: Vocabulary, kept: dict) -> np.ndarray:
        """kept: of the words seen so far, their answers and votes."""
        words = [letters(t) for t in texts]
        at = offsets([len(x) for x in words])
        if len(seen.rows) > seen.limit:
            seen.forget()
            kept.clear()
        ids = seen.ids([x for one in words for x in one])
        if fresh := seen.fresh():
            more = self.network.answers(self.network.embed(seen.rows[-len(fresh) :]))
            old = kept.get("answers")
            kept["answers"] = [[np.concatenate((o, x)) for o, x in zip(a, b, strict=True)] for a, b in zip(old, more, strict=True)] if old else more
            kept["votes"] = np.concatenate((kept["votes"], votes_of(fresh))) if old else votes_of(fresh)
        if not len(ids):
            return np.full(len(texts), 1 / (1 + np.exp(-float(self.network.logits(np.zeros((1, self.network.w["out"].size)))[0] + self.shift[0]))))
        z = self.network.logits(self.network.pooled(ids, at, kept["answers"])) + self.shift[_language(ids, at, kept["votes"])]
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of the rows of at most max_per_class labelled ids of each class, chosen by a hash of the id; counts of all labels by class."""
    have = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in have.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [have.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for y in (0, 1)]
    # at most 2 * max_per_class ids: a proven bound for the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id"), counts


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y, held) of every labelled id that `keep` holds for, one row an id; counts of all labels by class."""
    have = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in have.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(have, "doc_id")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 3
    return one_row(rows).withColumn("held", held), counts


#: What is encoded together shares its words' table rows, so that they take less room than the texts do.
ENCODED = "held boolean, y array<int>, lang array<int>, lengths array<int>, words binary, grams binary"


def encode(rows: DataFrame, p: Params) -> DataFrame:
    """Rows (text, y, held), staged, some MB of texts in a row for each of held: their labels, languages and lengths, their words as numbers (u2, or u4 if
    there are many) of the different words among them, and the table rows of these (i4, 6 a word). Texts are cut into words once, not in each round."""

    def run(batches):
        seen, votes = Vocabulary(p.hash_bits), votes_of([])
        for part in chunks(batches, budget=8 << 20, rows=4096):
            if len(seen.rows) > seen.limit:
                seen.forget()
                votes = votes_of([])
            parts = [seen.ids(letters(t.as_py())) for t in part["text"]]
            votes = np.concatenate((votes, votes_of(seen.fresh())))
            at = offsets([len(x) for x in parts])
            ids, lang = np.concatenate(parts), np.zeros(len(parts), int)
            if len(ids):
                lang = _language(ids, at, votes)
            y, held = (part[c].to_numpy(zero_copy_only=False) for c in ("y", "held"))
            for side in (False, True):
                pick = held == side
                if pick.any():
                    words = ids[np.repeat(pick, np.diff(at))]
                    there = np.zeros(len(seen.rows), bool)
                    there[words] = True
                    own = np.flatnonzero(there)
                    words = (np.cumsum(there) - 1)[words].astype("<u2" if len(own) <= 1 << 16 else "<u4")
                    grams = seen.rows[own].astype("<i4")
                    columns = [[side], *([v[pick].tolist()] for v in (y, lang, np.diff(at))), [words.tobytes()], [grams.tobytes()]]
                    kinds = [pa.bool_(), *[pa.list_(pa.int32())] * 3, pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, kinds, strict=True)], names=["held", "y", "lang", "lengths", "words", "grams"])

    return stage(rows.mapInArrow(run, ENCODED), compression="zstd")


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(word ids, offsets, labels, table rows by id, languages) of some MB of encoded rows at a time."""
    for part in chunks(batches, "words", 4 << 20):
        grams = [np.frombuffer(v.as_py(), "<i4").reshape(-1, 6) for v in part["grams"]]
        y, lang, lengths = (part[c].flatten().to_numpy() for c in ("y", "lang", "lengths"))
        sizes = [sum(v.as_py()) for v in part["lengths"]]
        words = [np.frombuffer(v.as_py(), "<u4" if n and len(v.as_py()) == 4 * n else "<u2").astype(np.int32) for v, n in zip(part["words"], sizes, strict=True)]
        first = offsets([len(g) for g in grams])
        yield np.concatenate([w + np.int32(k) for w, k in zip(words, first[:-1], strict=True)]), offsets(lengths), y.astype(np.float32), np.concatenate(grams), lang


#: So many rows of the table are added up together.
BLOCK = 1024


def _summed(rows: DataFrame, run, add, tasks: int) -> list[tuple[int, bytes, bytes]]:
    """What `add` makes of the (at, v) of each part, in the order of shards, where `run` gives (part, at, v) for the batches of a shard. Tasks add up: the
    driver gets one (part, at, v) a part, however many shards there are."""

    def given(batches):
        from pyspark import TaskContext

        if out := list(run(batches)):
            part, at, v = zip(*out, strict=True)
            shard = np.full(len(out), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(shard), pa.array(at, pa.binary()), pa.array(v, pa.binary())], names=["part", "shard", "at", "v"])

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        part = t["part"][0].as_py()
        at, v = add(part, [(a.as_py(), b.as_py()) for a, b in zip(t["at"], t["v"], strict=True)])
        return pa.table({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.binary()), "v": pa.array([v], pa.binary())})

    parts = rows.mapInArrow(given, "part int, shard int, at binary, v binary").repartition(tasks, "part")
    return [(r["part"], bytes(r["at"]), bytes(r["v"])) for r in parts.groupBy("part").applyInArrow(added, "part int, at binary, v binary").collect()]


def counted(rows: DataFrame, p: Params, tasks: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """By label, in how many texts each row of the table stands, and how many texts there are."""

    def run(batches):
        df, texts = np.zeros((2, 1 << p.hash_bits), np.int32), np.zeros(2, np.int64)
        for ids, at, y, grams, _ in encoded(batches):
            for label, first, last in zip(y.astype(int).tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                df[label, grams[ids[first:last]].ravel()] += 1  # a row counts once, however often it is named
                texts[label] += 1
        if texts.any():
            yield -1, b"", texts.tobytes()
            yield from ((k, b"", part.tobytes()) for k, part in enumerate(np.split(df, range(BLOCK, df.shape[1], BLOCK), axis=1)) if part.any())

    def add(part, values):
        return b"", np.sum([np.frombuffer(v, np.int64 if part < 0 else np.int32) for _, v in values], axis=0, dtype=np.int64).tobytes()

    df, texts = np.zeros((2, 1 << p.hash_bits), np.int64), np.zeros(2, np.int64)
    for part, _, v in _summed(rows, run, add, tasks):
        if part < 0:
            texts = np.frombuffer(v, np.int64)
        else:
            df[:, part * BLOCK : (part + 1) * BLOCK] = np.frombuffer(v, np.int64).reshape(2, -1)
    return df, texts


def learn(rows: DataFrame, net: Network, weight: np.ndarray, epochs: int, turn: int, tasks: int = 1) -> None:
    """Each shard of the rows learns for some epochs from the network as it is, which then takes over what they have learnt: means by their rows; a row of
    the table moves by the mean of the shards that changed it."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # set by Params alone
    width = 2 * net.p.dims

    def run(batches):
        from pyspark import TaskContext

        old = shared.value
        own, n, changed = copy.deepcopy(old), 0, np.zeros(len(old.squares), bool)
        r = np.random.default_rng((old.p.seed + 1, turn, TaskContext.get().partitionId()))
        for ids, at, y, grams, _ in encoded(batches):
            changed |= own.fit(ids, at, y, weight[y.astype(int)], grams, epochs, r)
            n += len(y)
        if n:
            yield -1, np.array([n, own.step], "<f8").tobytes(), own.small().tobytes()
            at = np.flatnonzero(changed)
            for here in np.split(at, np.flatnonzero(np.diff(at // BLOCK)) + 1):
                if len(here):
                    moved = np.concatenate((own.w["e"][here] - old.w["e"][here], own.squares[here] - old.squares[here]), axis=1)
                    yield int(here[0] // BLOCK), here.astype("<i4").tobytes(), moved.astype("<f4").tobytes()

    def add(part, values):
        if part < 0:
            n, step = np.array([np.frombuffer(a, "<f8") for a, _ in values]).T
            return np.array([n.sum(), step.max()], "<f8").tobytes(), np.average([np.frombuffer(v, "<f8") for _, v in values], axis=0, weights=n).tobytes()
        moved, times = np.zeros((BLOCK, width)), np.zeros(BLOCK)
        for a, v in values:
            at = np.frombuffer(a, "<i4") - part * BLOCK
            moved[at] += np.frombuffer(v, "<f4").reshape(-1, width)
            times[at] += 1
        at = np.flatnonzero(times)
        return (at + part * BLOCK).astype("<i4").tobytes(), (moved[at] / times[at, None]).astype("<f4").tobytes()

    for part, a, v in _summed(rows, run, add, tasks):
        if part < 0:
            net.step = int(np.frombuffer(a, "<f8")[1])
            net.take(np.frombuffer(v, "<f8"))
        else:
            at, moved = np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4").reshape(-1, width)
            net.w["e"][at] += moved[:, : net.p.dims]
            net.squares[at] += moved[:, net.p.dims :]
    shared.destroy()


def answered(rows: DataFrame, net: Network) -> np.ndarray:
    """(language, label, z in steps of 1 / STEPS, n) of the rows, added up, as four vectors; bounded by the number of steps."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        own = shared.value
        for ids, at, y, grams, lang in encoded(batches):
            z = own.logits(own.pooled(ids, at, own.answers(own.embed(grams)) if len(grams) else []))
            step = np.clip(np.floor(z * STEPS), -LIMIT * STEPS, LIMIT * STEPS).astype(np.int32)
            found, n = np.unique(np.stack([lang, y.astype(int), step]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in found), pa.array(n.astype(np.int64))], names=["lang", "y", "step", "n"])

    cells = rows.mapInArrow(run, "lang int, y int, step int, n long").groupBy("lang", "y", "step").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    return np.array([c.to_numpy() for c in cells.columns], np.int64).reshape(4, -1)


def shifts(cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """By language, what moves its best threshold to 0.3; of all languages where one has fewer than 10 rows of a class."""
    lang, y, step, n = cells
    z, mass = (step + 0.5) / STEPS, n * weight[y]
    whole, out = _threshold(z, y, mass), np.zeros(len(LANGS))
    for k in range(len(LANGS)):
        own = lang == k
        enough = all(n[own & (y == c)].sum() >= 10 for c in (0, 1))
        out[k] = np.log(0.3 / 0.7) - (_threshold(z[own], y[own], mass[own]) if enough else whole)
    return out


def fit(docs: DataFrame, labels: DataFrame, keep: Column, p: Params = Params()) -> Model:
    """Fit on all labelled rows for which `keep` holds. Only sums of the network's size come to the driver, one a round."""
    found, counts = labelled(docs, labels, "toxic", keep)
    rows = encode(found, p)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    have = {(r["y"], r["held"]): r["n"] for r in rows.select("held", F.explode("y").alias("y")).groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    n = np.array([sum(v for (y, _), v in have.items() if y == c) for c in (0, 1)])
    if n.sum() < 8 or not n.all():
        discard(rows)
        return Model(None, np.zeros(len(LANGS)), prior)
    whole = not all((c, h) in have for c in (0, 1) for h in (False, True))  # a class is too small to be split
    shards = max(1, min(p.shards, int(n.sum()) // p.shard_rows))
    train = (rows if whole else rows.where("not held")).coalesce(shards)
    net = Network(p)
    df, texts = counted(train, p, shards)
    net.start(df, texts)
    net.begin()
    each = np.sqrt(0.5 * texts.sum() / texts).astype(np.float32)  # between equal classes and their true shares
    for turn in range(p.rounds):
        learn(train, net, each / np.average(each, weights=texts), p.epochs // p.rounds, turn, shards)
    del net.m, net.squares
    cells = answered(rows if whole else rows.where("held"), net)
    discard(rows)
    return Model(net, shifts(cells, np.array([1 - prior, prior]) * n.sum() / n), prior)


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1 under the classes' true shares, in the middle of the gap that it falls into."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    hit, called = np.cumsum(y * weight), np.cumsum(weight)
    f1 = 2 * hit / (called + (y * weight).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document, from its whole text."""
    if model.network is None:
        return docs.select("doc_id", F.lit(float(model.prior)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, set by Params alone

    def run(batches):
        m = shared.value
        seen, kept = Vocabulary(m.network.p.hash_bits), {}
        for batch in chunks(batches):
            s = m.scores(batch["text"].to_pylist(), seen, kept)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s, pa.float64())], names=["doc_id", "score"])

    return as_bytes(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.3, p: Params = Params()) -> DataFrame:
    """The documents, with all their columns, that score below `cut`; a single pass without a shuffle."""
    model = fit(docs, labels, F.lit(True), p)
    if model.network is None:
        return docs.where(F.lit(model.prior < cut))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        seen, kept = Vocabulary(m.network.p.hash_bits), {}
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            keep = [m.scores([x or b"" for x in part["text"].to_pylist()], seen, kept) < cut for part in chunks([pa.RecordBatch.from_arrays([text], names=["text"])])]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
