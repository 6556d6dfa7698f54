"""Shared pieces of the corpus operators: tables, folds, stage tables, chunked Arrow input, word hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of the id, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def stage_dir(spark: SparkSession) -> str:
    """A new folder for this application below spark.checkpoint.dir, which all executors share. Only in local mode, where driver and executors are one
    process, a temporary folder serves if it is unset; it goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="orbitframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete this application's stage tables, when the results that read them are written."""
    base = stage_dir(spark).rsplit("/", 1)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark deletes a query's shuffle files when it ends, or leaves them until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs neither recompute it nor lose it with an executor. What was shuffled for
    it is deleted when it is written."""
    spark, path = df.sparkSession, stage_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stage` that nothing reads any more; anything that was made of them must have been staged or collected."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        for folder in {f.rsplit("/", 1)[0] for f in files}:
            if folder.rsplit("/", 2)[1] != spark.sparkContext.applicationId:
                raise ValueError(f"{folder} is no stage table of this application")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be none of the columns (upper and lower case are one in Spark)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_row(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, text, y) one for each id, that of the least hash of its text; repeated rows are combined before they are shuffled."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y"))
    return rows.groupBy("doc_id").agg(least.alias("r")).select("doc_id", "r.text", "r.y")


def as_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text as UTF-8 bytes); a null text is empty."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = 3 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `budget` bytes of text, so that a task's memory depends on neither the batch nor the table."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (total + n > budget or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII capitals to small letters, other ASCII but digits to spaces; bytes of non-ASCII letters stay.
LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def letters(text: bytes) -> list[bytes]:
    """Lower-cased words of letters and digits."""
    return text.translate(LOWER_WORDS).split()


def offsets(lengths: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1024, 1 << int(n).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64))) for b in (base, inverse))
        _POWERS[base] = have
    return have


def windows(h: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of `length` word hashes, in time that does not depend on length; h may hold several documents end to end."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if length == 1:
        return mix(h)
    up, down = _powers(base | 1, len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mix((sums[length:] - sums[:-length]) * down[:n])


def starts(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in documents laid end to end, where a window of `length` stays in its document, and the document's number of each."""
    counts = np.maximum(lengths - length + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), counts)
    first = offsets(lengths)[:-1]
    return np.arange(counts.sum()) - offsets(counts)[:-1][doc] + first[doc], doc


def segment_sums(rows: np.ndarray, index: np.ndarray, first: np.ndarray, most: int = 16) -> np.ndarray:
    """Sums of rows[index] over segments that begin at `first`: the k-th members of all segments are added at once; a segment longer than `most`
    is summed in pieces."""
    lengths = np.diff(np.append(first, len(index)))
    if len(lengths) and lengths.max() > most:
        pieces = -(-lengths // most)
        at = offsets(pieces)[:-1]
        cut = np.repeat(first - most * at, pieces) + most * np.arange(pieces.sum())
        return segment_sums(segment_sums(rows, index, cut), np.arange(len(cut)), at)
    order = np.argsort(-lengths, kind="stable")
    start, more = first[order], np.searchsorted(-lengths[order], -np.arange(1, most), side="left")
    out = rows.take(index[start], axis=0)
    for k, m in enumerate(more.tolist(), 1):
        if not m:
            break
        out[:m] += rows.take(index[start[:m] + k], axis=0)
    back = np.empty_like(out)
    back[order] = out
    return back


def spread(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def total(parts: DataFrame, kind: str = "f4", result: str | None = None) -> dict[int, np.ndarray]:
    """Sums (of type `result`) of the vectors v (bytes of `kind`) by part, of rows (part int, lane int, v binary): first by lane, so no task holds
    the vectors of all others. The parts and their lengths must be bounded: the sums come to the driver."""
    result = result or kind

    def add(own: str):
        def run(pdf):
            import pandas as pd

            out = np.zeros(len(pdf.v.iloc[0]) // np.dtype(own).itemsize, "f8")
            for v in pdf.v:
                out += np.frombuffer(v, own)
            return pd.DataFrame({"part": [pdf.part.iloc[0]], "lane": [pdf.lane.iloc[0]], "v": [out.astype(result).tobytes()]})

        return run

    schema = "part int, lane int, v binary"
    lanes = parts.groupBy("part", "lane").applyInPandas(add(kind), schema)
    return {r["part"]: np.frombuffer(r["v"], result) for r in lanes.groupBy("part").applyInPandas(add(result), schema).collect()}


def lane() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() % 64
