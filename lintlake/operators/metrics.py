"""Counts, totals, score and grade.

Every total of a scan comes from one small table, `tally`, so the texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake import schema
from lintlake.functions import severity as sev
from lintlake.operators.scan import hit_rows
from lintlake.rules import RuleSet, builtin_rules

GATE_LEVELS = ["critical", "high", "medium", "low", "none"]


def tally(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Files and lines per language, and findings per rule: at most one row for each.

    Rows of the first kind have a NULL `rule_id`. Matches are counted without being
    exploded, partly in each task, so only these few rows are shuffled. Takes what
    `scan_files` gives or, cheaper where it is not needed otherwise, `count_files`.
    """
    rules = builtin_rules() if rules is None else rules
    found = "counts" if "counts" in scanned.columns else "hits"
    entries = F.expr(
        "concat(array(named_struct('language', language, 'ord', cast(null as int), "
        "'files', 1L, 'lines', lines, 'findings', 0L)), "
        f"transform({found}, h -> named_struct('language', cast(null as string), 'ord', h.ord, "
        "'files', 0L, 'lines', 0L, 'findings', cast(h.matches as bigint))))"
    )
    counted = (
        # Never empty, so the same as an inner explode, but one Spark infers no filter from.
        scanned.select(F.inline_outer(entries))
        .groupBy("language", "ord")
        .agg(*[F.sum(c).alias(c) for c in ("files", "lines", "findings")])
    )
    table = rules.table(scanned.sparkSession).select("ord", "rule_id", "severity", "category")
    return counted.join(F.broadcast(table), "ord", "left").select(
        "language", "rule_id", "severity", "category", "files", "lines", "findings"
    )


def rule_counts(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """For each rule with findings: how many, and in how many files.

    A file's matches are summed within its row, so one row per rule leaves each task. The
    result of `count_files` has them summed already.
    """
    rules = builtin_rules() if rules is None else rules
    if "counts" in scanned.columns:
        per_file = F.expr("transform(counts, c -> named_struct('ord', c.ord, 'findings', c.matches))")
    else:
        per_file = F.expr(
            "transform(array_distinct(hits.ord), o -> named_struct('ord', o, 'findings', "
            "aggregate(filter(hits, h -> h.ord = o), 0L, (n, h) -> n + h.matches)))"
        )
    counted = (
        scanned.select(F.inline_outer(per_file))
        .where("ord IS NOT NULL")
        .groupBy("ord")
        .agg(F.sum("findings").alias("findings"), F.count("*").alias("files"))
    )
    table = rules.table(scanned.sparkSession)
    return counted.join(F.broadcast(table), "ord").select(
        "rule_id", "title", "severity", "category", "findings", "files"
    )


def severity_counts(tallied: DataFrame) -> DataFrame:
    """Findings by severity, from a tally."""
    return _by_rule_column(tallied, "severity")


def category_counts(tallied: DataFrame) -> DataFrame:
    """Findings by category, from a tally."""
    return _by_rule_column(tallied, "category")


def _by_rule_column(tallied: DataFrame, column: str) -> DataFrame:
    of_rules = tallied.where("rule_id IS NOT NULL")
    return of_rules.groupBy(column).agg(F.sum("findings").alias("findings"))


def severity_table(tallied: DataFrame) -> DataFrame:
    """Severities that occur, most severe first."""
    return (
        severity_counts(tallied)
        .withColumn("severity_rank", sev.severity_rank(F.col("severity")))
        .orderBy("severity_rank")
    )


def language_stats(files: DataFrame) -> DataFrame:
    """Files and lines by language, by name. Takes scanned files, clean ones included."""
    return (
        files.groupBy("language")
        .agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
        .orderBy("language")
    )


def languages_by_lines(files: DataFrame) -> DataFrame:
    """The same, largest first; ties by name."""
    return language_stats(files).orderBy(F.desc("lines"), "language")


def file_counts(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Findings by file, by path. The findings themselves stay rows, however many one
    file has; order them by path to read them file by file."""
    rules = builtin_rules() if rules is None else rules
    blocking = sev.is_blocking(F.element_at(_severities(rules), F.col("rule_ord") + 1))
    worst = sev.severity_rank(F.element_at(_severities(rules), F.col("rule_ord") + 1))
    return (
        hit_rows(scanned)
        .groupBy("file_path")
        .agg(
            F.sum("matches").alias("findings"),
            F.sum(F.when(blocking, F.col("matches")).otherwise(0)).alias("blocking"),
            F.min(worst).alias("worst_rank"),
        )
        .orderBy("file_path")
    )


def _severities(rules: RuleSet) -> Column:
    """Severities by rule position; positions left out of a set have none."""
    by_position = rules.by_position(lambda rule: rule.severity)
    return F.array(*[F.lit(name).cast("string") for name in by_position])


def rules_hit(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Each rule with findings, by its first finding, which also gives its columns.

    A file's matches of a rule are first summed within its row, and only path and line go
    through the aggregation: rank and text are the same for all findings of a rule and are
    joined to its one row. A rule with most of the findings is no hot partition, and no row
    is sorted before the few rules are left.
    """
    rules = builtin_rules() if rules is None else rules
    per_file = F.expr(
        "transform(array_distinct(hits.ord), o -> named_struct('ord', o, "
        "'line', array_min(transform(filter(hits, h -> h.ord = o), h -> h.line_number)), "
        "'findings', aggregate(filter(hits, h -> h.ord = o), 0L, (n, h) -> n + h.matches)))"
    )
    first = F.min(F.struct(F.col("path").alias("file_path"), F.col("line").alias("line_number")))
    places = (
        scanned.select("path", F.inline_outer(per_file))
        .where("ord IS NOT NULL")
        .groupBy("ord")
        .agg(first.alias("first"), F.sum("findings").alias("findings"), few_groups("ord"))
        .withColumn("ord", F.get("_group", F.lit(0)))
    )
    table = rules.table(scanned.sparkSession).select(
        F.col("ord").alias("rule_ord"), "rule_id", "title", "description", "severity", "cwe_id"
    )
    columns = ["title", "description", "severity", "cwe_id"]
    described = (
        places.join(F.broadcast(table), places["ord"] == table["rule_ord"])
        .select("rule_id", "first.*", "rule_ord", "findings", *columns)
        .withColumn("severity_rank", sev.severity_rank(F.col("severity")))
        .withColumn("match_ord", F.lit(1))
    )
    # One row per rule and position is left; positions that share an id become one.
    return (
        described.groupBy("rule_id")
        .agg(
            F.min(F.struct(*schema.ORDER_COLUMNS, *columns)).alias("first"),
            F.sum("findings").alias("findings"),
            few_groups("rule_id"),
        )
        .select(F.get("_group", F.lit(0)).alias("rule_id"), "first.*", "findings")
        .orderBy(*schema.ORDER_COLUMNS)
    )


def few_groups(key: str) -> Column:
    """An aggregate beside a minimum of texts, over few groups: the set of the group's own key.

    Spark sorts all rows for such a minimum, unless an aggregate that lives in an object stands
    beside it; then it keeps one entry per group in memory and sorts only beyond many groups.
    The key has to be read from the set, as an aggregate that nothing reads is left out.
    """
    return F.collect_set(key).alias("_group")


def skip_counts(files: DataFrame, reason: Column) -> DataFrame:
    """How many files a tree scan leaves out, by reason."""
    return (
        files.select(reason.alias("reason"))
        .where("reason IS NOT NULL")
        .groupBy("reason")
        .agg(F.count("*").alias("files"))
    )


def score(files: Column, lines: Column, deduction: Column) -> Column:
    """0 to 100 from the findings' deductions, with leniency for large sources."""
    size = F.greatest(F.lit(1.0), lines / F.lit(1000.0))
    adjusted = deduction / (F.lit(1.0) + size * F.lit(0.1))
    points = F.bround(F.lit(100.0) - adjusted, 0)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)).cast("int")
    return F.when(files == 0, 100).otherwise(bounded)


def _counts(entries: str, key: str) -> Column:
    """Sum the entries' findings by one of their fields, as a map."""
    return F.expr(
        f"map_from_entries(transform(array_sort(array_distinct({entries}.{key})), k -> "
        f"struct(k, aggregate(filter({entries}, e -> e.{key} = k), 0L, "
        "(total, e) -> total + e.findings))))"
    )


def summary(
    tallied: DataFrame, path: str = ".", scan_duration_ms: float = 0.0
) -> DataFrame:
    """One row about a whole scan, from its tally."""
    is_rule = F.col("rule_id").isNotNull()
    cost = F.col("findings") * sev.deduction(F.col("severity"))
    totals = tallied.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "lines", "findings")],
        F.coalesce(F.sum(cost), F.lit(0)).alias("deduction"),
        F.coalesce(
            F.sum(F.when(sev.is_blocking(F.col("severity")), F.col("findings"))), F.lit(0)
        ).alias("blocking"),
        # Bounded: one entry per rule, one per language.
        F.collect_list(F.when(is_rule, F.struct("severity", "category", "findings"))).alias("hit"),
        F.collect_list(
            F.when(~is_rule & F.col("language").isNotNull(),
                   F.struct("language", F.struct("files", "lines")))
        ).alias("languages"),
    )
    points = score(F.col("files"), F.col("lines"), F.col("deduction"))
    return totals.select(
        F.lit(path).alias("path"),
        F.col("files").alias("files_scanned"),
        F.lit(0).cast("bigint").alias("files_skipped"),
        F.col("lines").alias("lines_scanned"),
        F.round(F.lit(float(scan_duration_ms)), 2).alias("scan_duration_ms"),
        F.col("findings").alias("total_findings"),
        _counts("hit", "severity").alias("severity_counts"),
        _counts("hit", "category").alias("category_counts"),
        F.map_from_entries(F.array_sort("languages")).alias("language_stats"),
        "deduction",
        "blocking",
        points.alias("score"),
        sev.score_to_grade(points).alias("grade"),
    )


def severity_count(name: str) -> Column:
    """One severity's count in a summary row, 0 if it has none."""
    return F.coalesce(F.element_at("severity_counts", F.lit(name)), F.lit(0))


def caller_outputs(summary_row: DataFrame) -> DataFrame:
    """The counts, score and grade handed to a calling workflow, in one row."""
    return summary_row.select(
        F.col("total_findings").alias("total"),
        *[severity_count(name).alias(name) for name in ("critical", "high", "medium", "low")],
        "score",
        "grade",
    )


def gate(summary_row: DataFrame) -> DataFrame:
    """For each gate level, whether a scan fails it. Level low takes every finding."""
    critical, high, medium = (severity_count(s) for s in ("critical", "high", "medium"))
    over = {
        "critical": critical,
        "high": critical + high,
        "medium": critical + high + medium,
        "low": F.col("total_findings"),
        "none": F.lit(0),
    }
    verdicts = [F.struct(F.lit(k).alias("level"), (over[k] > 0).alias("fails")) for k in GATE_LEVELS]
    return summary_row.select(F.inline(F.array(*verdicts)))
