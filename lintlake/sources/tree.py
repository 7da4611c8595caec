"""A directory tree as a corpus, listed and read on the executors.

Spark's own file sources leave out names that start with `_` or `.`, which a source scan
must see, so directories are listed level by level with one Spark job each, and files are
read by the tasks that scan them. Only paths are shuffled. The root must be reachable from
every executor: a shared mount, or any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schema
from lintlake.functions import paths, text
from lintlake.sources.store import keep
from lintlake.sources.tables import scannable

# What runs on the executors travels with the job, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A read task is given about this many bytes of files, and hands them on in batches.
_BYTES_PER_TASK = 128 * 1024 * 1024
_BYTES_PER_BATCH = 16 * 1024 * 1024
_ENTRIES_PER_BATCH = 10_000
# A listing task is given this many directories.
_DIRECTORIES_PER_TASK = 16

_ENTRY = "path string, is_dir boolean, size bigint"


def _is_uri(path: str) -> bool:
    return "://" in path


def _absolute(path: str) -> str:
    if _is_uri(path):
        return path.rstrip("/")
    return os.path.abspath(path.removeprefix("file:"))


def _entries(root: str, directory: str, strict: bool) -> Iterator[tuple[str, bool, int | None]]:
    """(path below root, is a directory to enter, size) of what one directory holds.

    A directory that cannot be listed is one entry, its path with a slash behind it and no
    size; if `strict`, or for the root, it is an error.
    """
    below = f"{directory}/" if directory else ""
    try:
        yield from _listed(root, directory, below)
    except OSError:
        if strict or not directory:
            raise
        yield below, False, None


def _listed(root: str, directory: str, below: str) -> Iterator[tuple[str, bool, int | None]]:
    if _is_uri(root):
        system, base = fs.FileSystem.from_uri(root)
        for info in system.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/"))):
            yield below + info.base_name, info.type == fs.FileType.Directory, info.size
        return
    with os.scandir(os.path.join(root, directory)) as listing:
        for entry in listing:
            if entry.is_dir():
                if not entry.is_symlink():
                    yield below + entry.name, True, None
                continue
            try:
                size = entry.stat().st_size
            except OSError:
                size = None
            yield below + entry.name, False, size


def _batches(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == _ENTRIES_PER_BATCH:
            yield pd.DataFrame(batch, columns=columns)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=columns)


def list_tree(
    spark: SparkSession, root: str, skipped=paths.is_skipped, strict: bool = False
) -> DataFrame:
    """(path, size) of every file below the root, paths relative to it.

    `skipped` says of a path column whether one of its directories is left out; those are
    never entered. `size` is NULL where it cannot be read. A root that cannot be listed is an
    error. A directory below it that cannot is a row, its path ending in a slash, or an error
    if `strict`.
    """
    root = _absolute(root)

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (
            entry for frame in frames for name in frame["path"] for entry in _entries(root, name, strict)
        )
        for frame in _batches(rows, ["path", "is_dir", "size"]):
            yield frame.astype({"size": "Int64"})

    directories = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        entries = keep(directories.mapInPandas(expand, _ENTRY))
        levels.append(entries.where("NOT is_dir").select("path", "size"))
        # A directory is skipped by its own name, so ask for a file inside it.
        inside = F.concat("path", F.lit("/."))
        directories = entries.where("is_dir").where(~skipped(inside)).select("path")
        count = directories.count()
        if count == 0:
            break
        directories = directories.repartition(-(-count // _DIRECTORIES_PER_TASK))
    return reduce(DataFrame.unionByName, levels)


def _is_file(path: str) -> bool:
    if not _is_uri(path):
        return os.path.isfile(path)
    system, base = fs.FileSystem.from_uri(path)
    return system.get_file_info(base).type == fs.FileType.File


def _opener(root: str) -> Callable[[str], BinaryIO]:
    """How to open a path below the root for reading, on an executor."""
    if _is_uri(root):
        system, base = fs.FileSystem.from_uri(root)
        return lambda path: system.open_input_stream(f"{base}/{path}" if path else base)
    return lambda path: open(f"{root}/{path}" if path else root, "rb")


def _spread_by_size(listing: DataFrame) -> DataFrame:
    """Paths over so many tasks that each has about `_BYTES_PER_TASK` to read."""
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cores = listing.sparkSession.sparkContext.defaultParallelism
    return listing.repartition(max(4 * cores, -(-total // _BYTES_PER_TASK)))


def read_bytes(listing: DataFrame, root: str) -> DataFrame:
    """The listed files' contents: (path, size, content), content NULL where unreadable."""
    root = _absolute(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opener(root)
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with opened(row["path"]) as file:
                        row["content"] = file.read()
                except OSError:
                    row["content"] = None
                rows.append(row)
                held += len(row["content"] or b"")
                if held >= _BYTES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _CONTENT)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _CONTENT)

    return _spread_by_size(listing).mapInArrow(read, "path string, size bigint, content binary")


_CONTENT = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def hash_files(listing: DataFrame, root: str) -> DataFrame:
    """(path, sha256) of the listed files, read in pieces: a file may exceed what a row
    can hold. A file that cannot be read fails the job."""
    root = _absolute(root)

    def digest(opened, path: str) -> str:
        made = hashlib.sha256()
        with opened(path) as file:
            while piece := file.read(_BYTES_PER_BATCH):
                made.update(piece)
        return made.hexdigest()

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = _opener(root)
        for frame in frames:
            yield pd.DataFrame(
                {"path": frame["path"], "sha256": [digest(opened, p) for p in frame["path"]]}
            )

    return _spread_by_size(listing).mapInPandas(hashed, "path string, sha256 string")


def read_tree(
    spark: SparkSession, root: str, max_size: int = schema.MAX_FILE_SIZE
) -> DataFrame:
    """Files below a directory: known language, at most `max_size` bytes, no skipped
    directory on the way. A file as root is read alone, see `read_file`."""
    root = _absolute(root)
    if _is_file(root):
        return read_file(spark, root)
    listing = list_tree(spark, root).withColumn("language", paths.detect_language(F.col("path")))
    wanted = scannable(listing, max_size).select("path", "size")
    return _decoded(read_bytes(wanted, root), F.col("path"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file, whatever its size or directory, reported as `.`."""
    path = _absolute(path)
    size = None if _is_uri(path) else os.path.getsize(path)
    one = spark.createDataFrame([("", size)], "path string, size bigint")
    one = one.where(paths.detect_language(F.lit(path)).isNotNull())
    return _decoded(read_bytes(one, path), F.lit(path)).withColumn("path", F.lit("."))


def _decoded(contents: DataFrame, language_path) -> DataFrame:
    return contents.select(
        "path",
        paths.detect_language(language_path).alias("language"),
        "size",
        text.decode_text(F.col("content")).alias("text"),
    )
