"""The same scan over a stream of files.

Scanning one file needs no other file, so the batch plan runs on a stream as it is and
keeps no state; totals and reports are then taken from the stored result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lintlake.operators.scan import scan_files
from lintlake.rules import RuleSet


def scan_available(
    files: DataFrame,
    output: str,
    checkpoint: str,
    rules: RuleSet | None = None,
    min_severity: str = "info",
) -> StreamingQuery:
    """Scan what has arrived since the last run into a Parquet table of scanned files."""
    return (
        scan_files(files, rules, min_severity)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
