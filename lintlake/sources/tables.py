"""Any table of paths and texts as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lintlake import schema
from lintlake.functions import paths
from lintlake.functions.text import decode_text


def from_table(
    table: DataFrame,
    path: str | Column,
    text: str | Column,
    language: str | Column | None = None,
    size: str | Column | None = None,
) -> DataFrame:
    """Files from a table.

    `language` is one language for all rows, a column, or (None) taken from the path.
    `size` is in bytes; by default that of the text. A binary text column is decoded.
    """
    path = F.col(path) if isinstance(path, str) else path
    text = F.col(text) if isinstance(text, str) else text
    content = text
    if isinstance(table.select(text).schema[0].dataType, BinaryType):
        content = decode_text(text)
    if language is None:
        language = paths.detect_language(path.cast("string"))
    elif isinstance(language, str):
        language = F.lit(language)
    if size is None:
        size = F.octet_length(text)
    elif isinstance(size, str):
        size = F.col(size)
    return table.select(
        path.cast("string").alias("path"),
        language.alias("language"),
        size.cast("bigint").alias("size"),
        content.alias("text"),
    )


def spread(table: DataFrame) -> DataFrame:
    """The table over at least as many tasks as there are cores.

    A scan is bound by the cores, so a table whose files Spark reads in fewer tasks, such as
    one small file, is dealt out first. One in more files or splits is scanned where it lies:
    no text is shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(4 * cores)


def skip_reason(max_size: int = schema.MAX_FILE_SIZE) -> Column:
    """Why a tree scan leaves a file out, NULL if it does not."""
    return (
        F.when(paths.is_skipped(F.col("path")), "directory")
        # A directory that could not be listed.
        .when(F.col("path").endswith("/"), "unreadable")
        .when(F.col("language").isNull(), "language")
        .when(F.col("size").isNull(), "unreadable")
        .when(F.col("size") > max_size, "size")
    )


def scannable(files: DataFrame, max_size: int = schema.MAX_FILE_SIZE) -> DataFrame:
    """The files a tree scan reads: no skipped directory, known language, not too large.

    Paths are below the scan root.
    """
    return files.where(skip_reason(max_size).isNull())
