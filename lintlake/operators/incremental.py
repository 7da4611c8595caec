"""A scan that starts from a stored one and searches only what has changed.

A stored scan keeps with each file a key: a hash of its language, its text and the rules. Files
whose path and key a stored scan has as often are not searched again. Only paths and keys are
joined; the stored rows of changed files, and the texts to search, are then found by a join with
what has changed, which is stored first, so that Spark knows its size and a small change moves
neither findings nor texts.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as txt
from lintlake.operators import metrics
from lintlake.operators.scan import scan_files
from lintlake.rules import RuleSet, builtin_rules
from lintlake.sources.store import keep

_SCAN = ["path", "language", "lines", "hits"]
_KEY = ["path", "scan_key"]


class Rescan(NamedTuple):
    """`scanned` is the whole scan; `gone` are stored rows that are not in it, `added` its new
    ones, both with their hits. All have `scan_key`, so `scanned` can be stored again."""

    scanned: DataFrame
    gone: DataFrame
    added: DataFrame


def _of_rules(active: RuleSet) -> str:
    listed = [(position, *rule) for position, rule, _ in active._rules]
    return hashlib.sha256(json.dumps(listed).encode()).hexdigest()


def scan_key(active: RuleSet) -> Column:
    """What a file's scan depends on besides its path, as a hash; null texts have their own."""
    content = F.coalesce(F.sha2(txt.unify_newlines(F.col("text")), 256), F.lit("-"))
    return F.sha2(
        F.concat_ws(":", F.lit(_of_rules(active)), F.coalesce("language", F.lit("-")), content), 256
    )


def keyed_scan(
    files: DataFrame, rules: RuleSet | None = None, min_severity: str = "info"
) -> DataFrame:
    """`scan_files` with `scan_key`, to be stored (`store.keep`, or written) for `rescan`.

    A text is searched and hashed in one pass over its row. Rows of one path and content are
    files of their own.
    """
    active = (builtin_rules() if rules is None else rules).at_least(min_severity)
    # The key goes with the path through the scan, which passes that column on as it is.
    both = F.struct(F.col("path"), scan_key(active).alias("scan_key"))
    scanned = scan_files(files.withColumn("path", both), active)
    return scanned.select("path.path", "language", "lines", "hits", "path.scan_key")


def rescan(
    files: DataFrame, stored: DataFrame, rules: RuleSet | None = None, min_severity: str = "info"
) -> Rescan:
    """The scan of the files, with the rows of a stored keyed scan where nothing has changed.

    Where the rules or their least severity are others than those of the stored scan, all files
    count as changed. A null path is a path like any other.
    """
    active = (builtin_rules() if rules is None else rules).at_least(min_severity)
    now = files.select("path", scan_key(active).alias("scan_key")).groupBy(_KEY).count()
    before = stored.groupBy(*[F.col(c).alias(f"old_{c}") for c in _KEY]).agg(F.count("*").alias("old_count"))
    same = F.col("path").eqNullSafe(F.col("old_path")) & (F.col("scan_key") == F.col("old_scan_key"))
    met = keep(now.join(before, same, "full").where("NOT (count <=> old_count)"))
    new = met.where("scan_key IS NOT NULL").select(F.col("path").alias("new_path"), F.col("scan_key").alias("new_key"))
    old = met.where("old_scan_key IS NOT NULL").select("old_path", "old_scan_key")

    is_old = F.col("path").eqNullSafe(F.col("old_path")) & (F.col("scan_key") == F.col("old_scan_key"))
    is_new = F.col("path").eqNullSafe(F.col("new_path")) & (scan_key(active) == F.col("new_key"))
    changed = files.join(new, is_new, "left_semi")
    added = keep(keyed_scan(changed, active))
    columns = [*_SCAN, "scan_key"]
    kept = stored.join(old, is_old, "left_anti").select(columns)
    gone = stored.join(old, is_old, "left_semi").select(columns)
    return Rescan(kept.unionByName(added.select(columns)), gone, added)


def adjusted_tally(tallied: DataFrame, changes: Rescan, rules: RuleSet | None = None) -> DataFrame:
    """The tally of the whole scan from the stored scan's and the rows that changed only."""
    keys = ["language", "rule_id", "severity", "category"]
    counts = ["files", "lines", "findings"]
    gone = metrics.tally(changes.gone, rules)
    taken = gone.select(*keys, *[(-F.col(c)).alias(c) for c in counts])
    parts = tallied.select(*keys, *counts).unionByName(taken)
    parts = parts.unionByName(metrics.tally(changes.added, rules).select(*keys, *counts))
    summed = parts.groupBy(keys).agg(*[F.sum(c).alias(c) for c in counts])
    # Rows that count nothing any more are in no tally.
    return summed.where("files > 0 OR findings > 0")
