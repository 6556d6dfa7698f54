"""Files in any store that Arrow reaches (local, HDFS, S3, GCS), by URI or path, and a shared folder for tables of one application."""

from __future__ import annotations

import atexit
import fnmatch
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Found:
    path: str
    size: int


def listed(path: str, names: str = "*") -> list[Found]:
    """Files at a path (a file, or a folder and what is below it) whose name matches, by name; names that begin with _ or . are hidden. `path` may end
    in a pattern such as dir/*.pp."""
    head, _, last = path.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        path, names = head, last
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [Found(info.path, info.size)]
    inside = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    hidden = [x for x in inside if x.type == fs.FileType.File and not re.search(r"(^|/)[_.]", x.path[len(inner) :])]
    return sorted((Found(x.path, x.size) for x in hidden if fnmatch.fnmatch(x.base_name, names)), key=lambda x: x.path)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only in local mode a temporary one serves if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="orbitframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
