"""Findings as a table on file, laid out so that a question about some rules reads little.

The table is partitioned by severity, and within a severity its files hold ranges of rules and
paths in order. A rule's severity is known before the table is read, so a question by rules
reads their severities' partitions alone, and of those the row groups whose range of rules
meets; the order within makes the ranges narrow.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.rules import RuleSet, builtin_rules

_WITHIN = ["severity", "rule_id", "file_path", "line_number"]


def write_findings(found: DataFrame, path: str, mode: str = "error") -> None:
    """Write findings (a column `severity` and `rule_id` at least) below a folder.

    Ranges are by rule and path, so a rule with most findings is many files.
    """
    order = [name for name in _WITHIN if name in found.columns]
    placed = found.hint("rebalance").repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode(mode).partitionBy("severity").parquet(path)


def read_findings(
    spark: SparkSession,
    path: str,
    rule_ids: Iterable[str] | None = None,
    categories: Iterable[str] = (),
    min_severity: str = "info",
    rules: RuleSet | None = None,
) -> DataFrame:
    """Findings on file: of some rules or categories (none named: of all), from a severity up.

    Rules that the set does not have are looked for in all severities.
    """
    every = builtin_rules() if rules is None else rules
    rules = every.at_least(min_severity)
    table = spark.read.parquet(path)
    named = None if rule_ids is None and not categories else list(rule_ids or ())
    if named is None:
        return table.where(F.col("severity").isin(sorted({rule.severity for rule in rules})))
    wanted = list(rules.only(named, categories))
    known = {rule.rule_id for rule in wanted}
    by_rule = F.col("rule_id").isin(sorted(known)) & F.col("severity").isin(sorted({r.severity for r in wanted}))
    unknown = sorted(set(named) - {rule.rule_id for rule in every})
    if unknown and min_severity == "info":
        return table.where(by_rule | F.col("rule_id").isin(unknown))
    return table.where(by_rule)
