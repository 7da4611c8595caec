"""File-hash manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schema
from lintlake.sources.tree import hash_files, list_tree


def is_excluded(path: Column) -> Column:
    """Whether any part of the path is a name kept out of manifests."""
    names = F.array(*[F.lit(name) for name in schema.MANIFEST_EXCLUDED])
    return F.arrays_overlap(F.split(path, "/", -1), names)


def manifest(contents: DataFrame) -> DataFrame:
    """(path, sha256) in path order, from a table with path and content."""
    hashed = contents.where(~is_excluded(F.col("path"))).select(
        "path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")
    )
    return _by_path(hashed)


def _by_path(hashed: DataFrame) -> DataFrame:
    # The rebalance keeps the sort's sampling from reading and hashing a second time.
    return hashed.hint("rebalance").orderBy("path")


def tree_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a directory tree, whatever the files' language or size.

    A directory or file that cannot be read is an error: a manifest has no holes.
    """
    listing = list_tree(spark, root, skipped=is_excluded, strict=True).where(~is_excluded(F.col("path")))
    return _by_path(hash_files(listing, root))
