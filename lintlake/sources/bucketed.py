"""Scans stored in buckets by fingerprint, so that comparing two of them shuffles nothing.

A scan's slim rows are written once as a bucketed table: hashed by the whole fingerprint (rule,
path, line's hash) into a number of buckets and sorted in each. Two tables with one number of
buckets are joined bucket by bucket by `compare.new_findings` and its like, and the baseline's
distinct fingerprints are found in place. That pays for a baseline that many later scans are
held against: it is shuffled when it is written and never again.

The fingerprint has the path and the line in it, so neither a rule nor a file with most of the
findings is one bucket; only equal lines of one file lie together. Choose `buckets` so that one
holds some hundred megabytes, and the same for all scans that will be compared: with different
numbers the join is right, but one side is shuffled.

The catalogue knows a table as bucketed, not its folder. A session that has not written the
table opens its folder with `open_hits`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.operators.compare import FINGERPRINT, fingerprints
from lintlake.rules import RuleSet


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def write_hits(
    scanned: DataFrame,
    table: str,
    buckets: int,
    path: str | None = None,
    rules: RuleSet | None = None,
) -> DataFrame:
    """Write a scan's slim rows with their fingerprints as a bucketed table, and read it.

    The table must not exist; `path` names its folder, by default one in the warehouse. Files
    without findings leave no row. A null path has a bucket like any other, and equals none.
    """
    placed = fingerprints(scanned, rules).repartition(buckets, *FINGERPRINT)
    writer = placed.write.format("parquet").bucketBy(buckets, *FINGERPRINT).sortBy(*FINGERPRINT)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(_quoted(table))
    return scanned.sparkSession.table(_quoted(table))


def open_hits(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """Name the folder that `write_hits` filled in another session, with its number of buckets."""
    columns = spark.read.parquet(path).schema.toDDL()
    key = ", ".join(FINGERPRINT)
    folder = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {_quoted(table)} ({columns}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS LOCATION '{folder}'"
    )
    return spark.table(_quoted(table))
