"""Data sources of the binary swath formats: spark.read.format("preprocessor").load(path), df.write.format("retrieval").save(path), and so on.

Granule files (`preprocessor`, `retrieval`) have an orbit header and then scans of one size; record files (`apriori`, `simulator`, `matchup`, `clusters`) a
header and then records of one size. A plan needs a listing alone: files are dealt in ranges of bytes, and a task reads the scans or records
that begin in its range. Of more than `maxTasks` ranges (512), a task reads several, so that many small files do not make as many tasks. Bounds on granule and scan, or on what a file's name says, are pushed down: a task seeks to the scans asked for, and
files whose name or header rules them out are not read. Only the columns of the schema are decoded. Gzipped files are read as a stream by one task.

Writing: a task writes each granule (or named file) it holds under a temporary name; the driver gives all of them their names when every task has
succeeded, and removes them otherwise. A granule must lie in one task (`write_granules` and `write_records` see to it), and two tasks with the same
granule are an error. Null numbers become -9999.9, or -99 for integers; places of a scan without a row hold these values too.

Options: path; scans ("3", "-2", "10:20", "-2:"); maxPartitionBytes; maxTasks; channels, conical, angles, surface, variant of the layout; clusters, the clusters in
the profile table of a retrieval file; errors "rows" (below); skip, a file that lists names not to read; compression "gzip", most_scans, algorithm and
header.<field> for writing.

With errors "rows" the schema has a column `error`: a file that cannot be read, or that holds less than its header promises, gives one row with its
path and what is wrong instead of failing the job. Rows that other tasks have read of it are for the caller to leave out (see operators/extraction)."""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from orbitframe.sources import granules, layouts, store
from orbitframe.sources.records import schema_of

PIECE = 4 << 20
TASKS = 512


@dataclass
class Form:
    """What the bytes of a format are: header and records, or scans of pixels."""

    header: np.dtype
    record: np.dtype
    scan: np.dtype | None = None
    skip: int = 0
    suffix: str = ""
    keys: tuple[str, ...] = ()
    name: re.Pattern | None = None


def form_of(kind: str, options: dict[str, str]) -> Form:
    n, angles = int(options.get("channels", layouts.CHANNELS)), int(options.get("angles", 1))
    conical, variant = options.get("conical", "true").lower() == "true", options.get("variant", "")
    if kind == "preprocessor":
        return Form(layouts.preprocessor_header(n), layouts.preprocessor_pixel(n, conical), layouts.PREPROCESSOR_SCAN, suffix=".pp")
    if kind == "retrieval":
        skip = 0 if variant == "sensitivity" else granules.profile_info(n_profiles=int(options.get("clusters", 80))).itemsize
        return Form(granules.retrieval_header(), layouts.retrieval_record(variant or "plain"), layouts.RETRIEVAL_SCAN, skip, ".BIN")
    if kind == "apriori":
        name = re.compile(r"gpm_(?P<t2m>\d{3})_(?P<tcwv>\d\d)(?:_(?P<airmass>\d\d))?_(?P<surface>\d\d)\.bin")
        return Form(layouts.bin_header(n, angles, conical), layouts.bin_record(int(options.get("surface", 1)), n, angles, conical), suffix=".bin", keys=("t2m", "tcwv", "airmass", "surface"), name=name)
    if kind == "simulator":
        return Form(layouts.sim_header(n, angles, conical), layouts.sim_record(n, angles, conical), suffix=".sim")
    if kind == "clusters":
        return Form(np.dtype([]), layouts.layout(f"profile f4 {layouts.LAYERS}"), suffix=".dat")
    return Form(np.dtype([]), layouts.mrms_record(variant or "conical", n), suffix=".bin")


def schema_of_form(form: Form, errors: bool = False) -> str:
    last = ", error string" if errors else ""
    if form.scan is not None:
        return f"path string, granule int, scan int, pixel int, {schema_of(form.scan)}, {schema_of(form.record)}{last}"
    keys = "".join(f"{k}_bin int, " for k in form.keys)
    return f"file string, record bigint, {keys}{schema_of(form.record)}{last}"


def to_arrow(values: np.ndarray) -> pa.Array:
    """Rows of numbers, or of arrays of them, without Python objects."""
    values = np.ascontiguousarray(values)
    if values.dtype.kind == "S":
        return pa.array(values.ravel().tolist(), pa.binary())
    out = pa.array(values.ravel())
    for axis in range(values.ndim - 1, 0, -1):
        n = int(np.prod(values.shape[:axis]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * values.shape[axis]), out)
    return out


def missing(kind: np.dtype):
    return -9999.9 if kind.base.kind == "f" else -99 if kind.base.kind == "i" else b""


def from_arrow(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Back to rows of a layout's field; nulls are missing values."""
    out = np.full((len(column), *kind.shape), missing(kind), kind.base)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.drop_null()
    for _ in kind.shape:
        flat = flat.flatten()
    if kind.base.kind == "S":
        out[there] = np.array(flat.to_pylist(), kind.base).reshape((-1, *kind.shape))
    else:
        holes = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
        values = (flat.fill_null(0) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(kind.base)
        if holes is not None:
            values[holes] = missing(kind)
        out[there] = values.reshape((-1, *kind.shape))
    return out


@dataclass
class Bounds:
    """What pushed filters allow a whole number to be."""

    low: int = -(1 << 62)
    high: int = 1 << 62
    among: set[int] | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter is one of those that are fully applied here."""
        if isinstance(f, In):
            if any(isinstance(v, float) or v is None for v in f.value):
                return False
            self.among = {int(v) for v in f.value} & (self.among if self.among is not None else {int(v) for v in f.value})
            return True
        if not isinstance(f, EqualTo | EqualNullSafe | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or isinstance(f.value, float) or f.value is None:
            return False
        v = int(f.value)
        if not isinstance(f, LessThan | LessThanOrEqual):
            self.low = max(self.low, v + isinstance(f, GreaterThan))
        if not isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.high = min(self.high, v - isinstance(f, LessThan))
        return True

    def __contains__(self, v: int | None) -> bool:
        free = self.low == -(1 << 62) and self.high == 1 << 62 and self.among is None
        return free or v is not None and self.low <= v <= self.high and (self.among is None or v in self.among)


@dataclass
class Part:
    """A range of a file's bytes."""

    path: str
    start: int
    end: int
    size: int
    keys: dict = field(default_factory=dict)


@dataclass
class Parts(InputPartition):
    """Ranges that one task reads, one after the other."""

    parts: list[Part]


def dealt(parts: list[Part], most: int) -> list[Parts]:
    """Each range a task of its own or, if there are more than `most`, runs of them with about the same bytes; ranges of a file that follow each
    other are joined, so that a task opens a file once."""
    if len(parts) <= most:
        return [Parts([p]) for p in parts]
    share, out, held = sum(p.end - p.start for p in parts) / most, [], 0
    for p in parts:
        if not out or held >= share * len(out):
            out.append(Parts([]))
        own = out[-1].parts
        if own and own[-1].path == p.path and own[-1].end == p.start:
            own[-1] = Part(p.path, own[-1].start, p.end, p.size, p.keys)
        else:
            own.append(p)
        held += p.end - p.start
    return out


def span(text: str | None, n: int) -> range:
    """The scans that an option such as -1, 3 or 10:20 names, of n."""
    if not text:
        return range(n)
    if ":" in text:
        a, _, b = text.partition(":")
        return range(n)[int(a) if a else None : int(b) if b else None]
    return range(n)[slice(int(text), int(text) + 1 or None)]


class Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str], schema: StructType):
        self.kind, self.options, self.schema = kind, dict(options), schema
        self.strict = self.options.get("errors") == "rows"
        self.columns = [c for c in schema.names if not (self.strict and c == "error")]
        self.form = form_of(kind, self.options)
        names = ("granule", "scan") if self.form.scan is not None else tuple(f"{k}_bin" for k in self.form.keys)
        self.bounds = {k: Bounds() for k in names}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name not in self.bounds or not self.bounds[name].take(f):
                yield f

    def partitions(self) -> Sequence[Parts]:
        most, out = int(self.options.get("maxpartitionbytes", 64 << 20)), []
        skip = set()
        if "skip" in self.options:
            system, path = store.resolve(self.options["skip"])
            with system.open_input_file(path) as file:
                skip = set(file.read().decode().split("\n"))
        for found in store.listed(self.options["path"], self.options.get("names", "*")):
            keys = {}
            if found.path in skip:
                continue
            if self.form.name:
                match = self.form.name.search(found.path)
                keys = {f"{k}_bin": None if match is None or match[k] is None else int(match[k]) for k in self.form.keys}
                if not all(v in self.bounds[k] for k, v in keys.items()):
                    continue
            step = found.size if found.path.endswith(".gz") else most
            out += [Part(found.path, a, min(a + step, found.size), found.size, keys) for a in range(0, max(found.size, 1), max(step, 1))]
        return dealt(out, int(self.options.get("maxtasks", TASKS)))

    def read(self, task: Parts | None) -> Iterator[pa.RecordBatch]:
        for part in task.parts if task is not None else []:  # None is what Spark asks for when there is no part
            yield from self._one(part)

    def _one(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not self.strict:
            yield from self._read(part)
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        whole = to_arrow_schema(self.schema)
        try:
            for batch in self._read(part):
                yield pa.RecordBatch.from_arrays([batch.column(f.name) if f.name != "error" else pa.nulls(batch.num_rows, pa.string()) for f in whole], schema=whole)
        except Exception as e:  # whatever is wrong with one file
            said = {"error": f"{type(e).__name__}: {e}"[:500], "path": part.path, "file": part.path}
            yield pa.RecordBatch.from_arrays([pa.array([said.get(f.name)], f.type) for f in whole], schema=whole)

    def _read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, path = store.resolve(self.options["path"])[0], part.path
        with system.open_input_file(path) as raw:
            magic = raw.read(2)
            raw.seek(0)
            whole = magic == b"\x1f\x8b"
            file = gzip.GzipFile(fileobj=raw) if whole else raw
            yield from self._scans(file, part, whole) if self.form.scan is not None else self._records(file, part, whole)

    def _pieces(self, file, base: int, size: int, numbers: range, kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first, items) of consecutive items of `size` bytes, some MB at a time; what is cut off is left out."""
        at, most = numbers.start, max(1, PIECE // size)
        while at < numbers.stop:
            file.seek(base + at * size)
            n = min(most, numbers.stop - at)
            content = file.read(n * size)
            rows = np.frombuffer(content, kind, len(content) // size)
            if len(rows):
                yield at, rows
            if len(rows) < n:
                if self.strict and numbers.stop < 1 << 61:
                    raise ValueError(f"ends in item {at + len(rows)} of {numbers.stop}")
                return
            at += n

    def _mine(self, part: Part, base: int, size: int, numbers: range, whole: bool) -> range:
        """Of the numbers those that begin in the part's bytes."""
        if whole:
            return numbers
        first = max(0, -(-(part.start - base) // size))
        end = -(-(part.end - base) // size) if part.end < part.size else 1 << 62
        return range(max(numbers.start, first), max(numbers.start, min(numbers.stop, end)))

    def _scans(self, file, part: Part, whole: bool) -> Iterator[pa.RecordBatch]:
        form = self.form
        content = file.read(form.header.itemsize)
        if len(content) < form.header.itemsize:
            if self.strict:
                raise ValueError("no whole header")
            return
        head = np.frombuffer(content, form.header, 1)[0]
        n, m, granule = int(head["number_of_scans"]), int(head["number_of_pixels"]), int(head["granule_number"])
        if granule not in self.bounds["granule"]:
            return
        kind = np.dtype([("scan", form.scan), ("pixels", form.record, (m,))])
        base, scan = form.header.itemsize + form.skip, self.bounds["scan"]
        if self.strict and not whole and part.size != base + max(n, 0) * kind.itemsize:
            raise ValueError(f"{n} scans of {m} pixels promised, {(part.size - base) / kind.itemsize:.1f} found")
        named = span(self.options.get("scans"), n)
        asked = range(max(named.start, scan.low), max(named.start, min(named.stop, scan.high + 1)))
        if scan.among is not None:
            inside = [s for s in scan.among if s in asked]
            asked = range(min(inside), max(inside) + 1) if inside else range(0)
        for at, rows in self._pieces(file, base, kind.itemsize, self._mine(part, base, kind.itemsize, asked, whole), kind):
            number = np.arange(at, at + len(rows), dtype="i4")
            if scan.among is not None:
                keep = np.isin(number, list(scan.among))
                rows, number = rows[keep], number[keep]
            size, columns = len(rows) * m, []
            for c in self.columns:
                if c == "path":
                    columns.append(pa.array([part.path]).take(pa.array(np.zeros(size, "i4"))))
                elif c == "granule":
                    columns.append(pa.array(np.full(size, granule, "i4")))
                elif c == "scan":
                    columns.append(pa.array(np.repeat(number, m)))
                elif c == "pixel":
                    columns.append(pa.array(np.tile(np.arange(m, dtype="i4"), len(rows))))
                elif c in form.scan.names:
                    columns.append(to_arrow(np.repeat(rows["scan"][c], m, axis=0)))
                else:
                    columns.append(to_arrow(rows["pixels"][c].reshape((size, *form.record[c].shape))))
            yield pa.RecordBatch.from_arrays(columns, names=self.columns)

    def _records(self, file, part: Part, whole: bool) -> Iterator[pa.RecordBatch]:
        form = self.form
        base, size = form.header.itemsize, form.record.itemsize
        numbers = range(1 << 62) if whole else range(max(0, (part.size - base) // size))
        for at, rows in self._pieces(file, base, size, self._mine(part, base, size, numbers, whole), form.record):
            columns, n = [], len(rows)
            for c in self.columns:
                if c == "file":
                    columns.append(pa.array([part.path]).take(pa.array(np.zeros(n, "i4"))))
                elif c == "record":
                    columns.append(pa.array(np.arange(at, at + n)))
                elif c in part.keys:
                    columns.append(pa.array([part.keys[c]], pa.int32()).take(pa.array(np.zeros(n, "i4"))))
                else:
                    columns.append(to_arrow(rows[c]))
            yield pa.RecordBatch.from_arrays(columns, names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary path, name)


class Writer(DataSourceArrowWriter):
    def __init__(self, kind: str, options: dict[str, str], overwrite: bool):
        self.kind, self.options, self.overwrite = kind, dict(options), overwrite
        self.form, self.temporary = form_of(kind, self.options), f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        key = "granule" if self.form.scan is not None else "file"
        done: list[tuple[str, str]] = []
        names, now, held = set(), None, []
        for batch in iterator:
            values = batch.column(batch.schema.get_field_index(key))
            if values.null_count:
                raise ValueError(f"{key} is null")
            values = values.to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1)) if len(values) else []
            for a, b in zip(begin, [*begin[1:], len(values)], strict=True):
                if values[a] != now:
                    if held:
                        done.append(self._flush(now, held))
                    now, held = values[a], []
                    if now in names:
                        raise ValueError(f"rows of {key} {now} do not stand together")
                    names.add(now)
                held.append(batch.slice(a, b - a))
        if held:
            done.append(self._flush(now, held))
        return Written(done)

    def _flush(self, key, held: list[pa.RecordBatch]) -> tuple[str, str]:
        rows = pa.Table.from_batches(held).combine_chunks()
        columns = {c: rows.column(c).chunk(0) for c in rows.column_names}
        name, content = self._granule(int(key), columns) if self.form.scan is not None else (str(key), self._named(columns))
        if self.options.get("compression", "") == "gzip":
            name, content = f"{name}.gz", gzip.compress(content, 1, mtime=0)
        system, folder = store.resolve(self.options["path"])
        system.create_dir(f"{folder}/{self.temporary}", recursive=True)
        path = f"{folder}/{self.temporary}/{uuid.uuid4().hex}"
        with system.open_output_stream(path) as out:
            out.write(content)
        return path, name

    def _headed(self, values: dict) -> np.ndarray:
        head = np.zeros(1, self.form.header)
        asked = {k[7:]: v for k, v in self.options.items() if k.startswith("header.")}
        for k in self.form.header.names or ():
            v = asked.get(k, values.get(k))
            if v is not None:
                head[k] = v.encode() if isinstance(v, str) and head.dtype[k].kind == "S" else v
        return head

    def _named(self, columns: dict[str, pa.Array]) -> bytes:
        rows = np.zeros(len(next(iter(columns.values()))), self.form.record)
        for c in rows.dtype.names:
            rows[c] = from_arrow(columns[c], rows.dtype[c]) if c in columns else missing(rows.dtype[c])
        return self._headed({}).tobytes() + rows.tobytes()

    def _granule(self, granule: int, columns: dict[str, pa.Array]) -> tuple[str, bytes]:
        form, most = self.form, self.options.get("most_scans")
        y, x = (columns[c].to_numpy(zero_copy_only=False).astype("i8") for c in ("scan", "pixel"))
        keep = np.flatnonzero(y < int(most)) if most else np.arange(len(y))
        y, x = y[keep], x[keep]
        n, m = (int(y.max()) + 1, int(x.max()) + 1) if len(y) else (0, 0)
        if len(np.unique(y * max(m, 1) + x)) < len(y):
            raise ValueError(f"granule {granule} has a place twice")
        rows = np.zeros(n, np.dtype([("scan", form.scan), ("pixels", form.record, (m,))]))
        for c in form.scan.names:
            rows["scan"][c] = missing(form.scan[c])
            if c in columns:
                rows["scan"][c][y] = from_arrow(columns[c], form.scan[c])[keep]
        for c in form.record.names:
            rows["pixels"][c] = missing(form.record[c])
            if c in columns:
                rows["pixels"][c][y, x] = from_arrow(columns[c], form.record[c])[keep]
        values = {"granule_number": granule, "number_of_scans": n, "number_of_pixels": m}
        name = f"{granule:06}{form.suffix}"
        if self.kind == "retrieval":
            algorithm = self.options.get("algorithm", "ORBIT")
            values |= {"algorithm": algorithm}
            if n:
                first, last = rows["scan"]["scan_date"][0], rows["scan"]["scan_date"][-1]
                values |= {"granule_start_date": first[:6], "granule_end_date": last[:6]}
                day, s, e = "".join(f"{v:02}" for v in first[:3]), "".join(f"{v:02}" for v in first[3:6]), "".join(f"{v:02}" for v in last[3:6])
                name = f"2A.{algorithm}.V0.{day}-S{s}-E{e}.{granule:06}.BIN"
        info = b"" if not form.skip else self._profile_info()
        return name, self._headed(values).tobytes() + info + rows.tobytes()

    def _profile_info(self) -> bytes:
        info = np.zeros(1, granules.profile_info(n_profiles=int(self.options.get("clusters", 80))))
        # Heights of the layers' tops in km, temperatures of the classes in K.
        info["height_top_layers"] = np.concatenate([np.linspace(0.5, 10, 20), np.linspace(11, 18, 8)])
        info["temperature"] = np.linspace(270.0, 303.0, 12)
        info["n_species"], info["n_temps"], info["n_layers"], info["n_profiles"] = 5, 12, layouts.LAYERS, int(self.options.get("clusters", 80))
        info["profiles"] = -9999.9
        return info.tobytes()

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = store.resolve(self.options["path"])
        files = [f for w in messages if w is not None for f in w.files]
        names = [name for _, name in files]
        system.create_dir(folder, recursive=True)
        there = store.listed(self.options["path"])
        twice = {x for x in names if names.count(x) > 1} if len(set(names)) < len(names) else set()
        if twice or not self.overwrite and (twice := {x.path.rpartition("/")[2] for x in there} & set(names)):
            self.abort(messages)
            raise ValueError(f"written twice: {sorted(twice)[:5]}")
        if self.overwrite:
            for x in there:
                system.delete_file(x.path)
        for path, name in files:
            system.move(path, f"{folder}/{name}")
        self._clean(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*store.resolve(self.options["path"]))

    def _clean(self, system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{folder}/{self.temporary}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.temporary}")


class SwathSource(DataSource):
    KIND = ""

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return schema_of_form(form_of(self.KIND, dict(self.options)), self.options.get("errors") == "rows")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.KIND, dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.KIND, dict(self.options), overwrite)


SOURCES = {kind: type(f"{kind.title()}Source", (SwathSource,), {"KIND": kind, "__module__": __name__}) for kind in ("preprocessor", "retrieval", "apriori", "simulator", "matchup", "clusters")}
globals().update({c.__name__: c for c in SOURCES.values()})


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, with filters pushed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES.values():
        spark.dataSource.register(source)


def write_granules(df: DataFrame, kind: str, path: str, mode: str = "append", **options) -> None:
    """Rows (granule, scan, pixel, columns of the format) as one file a granule."""
    register(df.sparkSession)
    dealt = df.repartition("granule").sortWithinPartitions("granule", "scan", "pixel")
    dealt.write.format(kind).options(**options).mode(mode).save(path)


def write_records(df: DataFrame, kind: str, path: str, order: list[str], mode: str = "append", **options) -> None:
    """Rows (file, columns of the format) as one file for each name, in the order given."""
    register(df.sparkSession)
    df.repartition("file").sortWithinPartitions("file", *order).write.format(kind).options(**options).mode(mode).save(path)


def read(spark: SparkSession, kind: str, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The rows of the files at a path; `columns` limits what is decoded."""
    register(spark)
    found = spark.read.format(kind).options(**options)
    if columns:
        whole = StructType.fromDDL(schema_of_form(form_of(kind, {k.lower(): v for k, v in options.items()}), options.get("errors") == "rows"))
        found = found.schema(StructType([whole[c] for c in columns]))
    return found.load(path)
