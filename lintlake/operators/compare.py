"""Compare scans with each other and with a list of suppressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text
from lintlake.operators.scan import describe, each_match, hit_rows
from lintlake.rules import RuleSet, builtin_rules

# What makes two findings the same.
FINGERPRINT = ["rule_key", "file_path", "line_hash"]


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """Add `line_hash`: the stripped line's hash, so a moved line keeps its identity."""
    return findings.withColumn("line_hash", F.sha2(text.strip(F.col("line_content")), 256))


def fingerprints(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """A scan's slim rows with their key: the first rule of the id, the path, the line's hash.

    Rows that have it already, as `sources.bucketed` stores them, stay as they are.
    """
    if set(FINGERPRINT) <= set(scanned.columns):
        return scanned
    rules = builtin_rules() if rules is None else rules
    first: dict[str, int] = {}
    for position, rule_id in enumerate(rules.by_position(lambda rule: rule.rule_id)):
        first.setdefault(rule_id, position)
    keys = [first[rule_id] for rule_id in rules.by_position(lambda rule: rule.rule_id)]
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("rule_ord") + 1)
    return with_fingerprint(hit_rows(scanned)).withColumn("rule_key", key)


def _compared(left: DataFrame, right: DataFrame, rules: RuleSet | None, how: str) -> DataFrame:
    """Findings of one scan that the other has, or has not, by fingerprint.

    Slim rows are joined, a line once for each rule however many matches are on it, against
    the other scan's distinct keys; rule text and repeated matches come after the join. Either
    side may be a scan or its `fingerprints`; two that are stored in buckets are not shuffled.
    """
    rules = builtin_rules() if rules is None else rules
    keys = fingerprints(right, rules).select(FINGERPRINT).distinct()
    joined = fingerprints(left, rules).join(keys, FINGERPRINT, how).drop("rule_key")
    return describe(each_match(joined), rules)


def new_findings(current: DataFrame, baseline: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Findings of the current scan whose fingerprint the baseline scan does not have."""
    return _compared(current, baseline, rules, "left_anti")


def fixed_findings(current: DataFrame, baseline: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Findings of the baseline scan that are gone from the current scan."""
    return _compared(baseline, current, rules, "left_anti")


def kept_findings(current: DataFrame, baseline: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Findings of the current scan that the baseline scan has too."""
    return _compared(current, baseline, rules, "left_semi")


def new_since_report(
    current: DataFrame, reported: DataFrame, rules: RuleSet | None = None
) -> DataFrame:
    """Findings of the current scan that a report does not have, by fingerprint.

    `reported` has rule_id, file_path and line_content, as `reports.read_findings` gives them.
    Only their fingerprints are joined with slim rows.
    """
    rules = builtin_rules() if rules is None else rules
    first: dict[str, int] = {}
    for position, rule_id in enumerate(rules.by_position(lambda rule: rule.rule_id)):
        first.setdefault(rule_id, position)
    known = current.sparkSession.createDataFrame(
        [(k, v) for k, v in first.items() if k is not None], "rule_id string, rule_key int"
    )
    keys = with_fingerprint(reported).join(F.broadcast(known), "rule_id").select(FINGERPRINT).distinct()
    joined = fingerprints(current, rules).join(keys, FINGERPRINT, "left_anti").drop("rule_key")
    return describe(each_match(joined), rules)


def _suppressed(
    scanned: DataFrame, suppressions: DataFrame, as_of: str, rules: RuleSet
) -> DataFrame:
    """A scan's slim rows with the reason of an entry in force, or NULL, as `suppressed_by`.

    Neither the rules' text nor repeated matches go through the joins. Spark's own estimate of
    the list's size picks the join; adaptive execution splits a rule that has most findings.
    """
    active = suppressions.where(
        F.col("expires").isNull() | (F.to_date("expires") >= F.to_date(F.lit(as_of)))
    ).withColumn("reason", F.coalesce("reason", F.lit("")))
    first = F.array_min(F.collect_set("reason"))
    by_file = (
        active.where("file_path IS NOT NULL").groupBy("rule_id", "file_path").agg(first.alias("file_reason"))
    )
    by_rule = active.where("file_path IS NULL").groupBy("rule_id").agg(first.alias("rule_reason"))
    ids = F.array(*[F.lit(rule_id) for rule_id in rules.by_position(lambda rule: rule.rule_id)])
    hits = hit_rows(scanned).withColumn("rule_id", F.get(ids.cast("array<string>"), F.col("rule_ord")))
    return (
        hits.join(by_file, ["rule_id", "file_path"], "left")
        .join(by_rule, "rule_id", "left")
        .withColumn("suppressed_by", F.coalesce("file_reason", "rule_reason"))
        .drop("rule_id", "file_reason", "rule_reason")
    )


def mark_suppressed(
    scanned: DataFrame, suppressions: DataFrame, as_of: str, rules: RuleSet | None = None
) -> DataFrame:
    """A scan's findings with `suppressed_by`: the reason of an entry in force on a date, else NULL.

    `suppressions` has rule_id, file_path (NULL: every file), expires (NULL: never) and
    reason; an entry holds through its expiry date. Where several hold, one for the very
    file goes before one for every file, then the first reason by name.
    """
    rules = builtin_rules() if rules is None else rules
    return describe(each_match(_suppressed(scanned, suppressions, as_of, rules)), rules)


def active_findings(
    scanned: DataFrame, suppressions: DataFrame, as_of: str, rules: RuleSet | None = None
) -> DataFrame:
    rules = builtin_rules() if rules is None else rules
    left = _suppressed(scanned, suppressions, as_of, rules).where("suppressed_by IS NULL")
    return describe(each_match(left.drop("suppressed_by")), rules)


def suppressed_findings(
    scanned: DataFrame, suppressions: DataFrame, as_of: str, rules: RuleSet | None = None
) -> DataFrame:
    """The suppressed rows with their reason: nothing is dropped without a trace."""
    rules = builtin_rules() if rules is None else rules
    taken = _suppressed(scanned, suppressions, as_of, rules).where("suppressed_by IS NOT NULL")
    return describe(each_match(taken), rules)
