"""Keep an intermediate table where every executor can read it again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "kept-"
# What is kept within `recorded` blocks, of the thread or task that opened them only.
_records: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("records", default=())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, else the warehouse's.

    Both are settings of the session and name a place that all executors share.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"


def keep(table: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the table as Parquet and go on from there; lost executors cost no recompute.

    It goes to `folder`, by default to one of its own below `shared_dir`. Later reads take
    the columns they need. `release` removes it.
    """
    spark = table.sparkSession
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/{_PREFIX}{uuid.uuid4().hex}"
    table.write.parquet(path)
    kept = spark.read.schema(table.schema).parquet(path)
    for record in _records.get():
        record.append(kept)
    return kept


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """A list of what is kept inside the block, to be released when no result needs it."""
    record: list[DataFrame] = []
    opened = _records.set((*_records.get(), record))
    try:
        yield record
    finally:
        _records.reset(opened)


def release(*tables: DataFrame) -> None:
    """Remove what `keep` stored for these tables, or for what they were made from."""
    for table in tables:
        # A table that was released already has no files.
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if path.rpartition("/")[2].startswith(_PREFIX):
                remove_folder(table.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it, on whatever file system its path names."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
