"""The scan: files joined with the rules that apply, every match with its line.

The plan reads each text once and shuffles nothing. Rules are grouped into one array per
language and joined to the files by a broadcast hash join, so a file stays one row. A rule
runs only where the strings it needs occur, and gives its matches with their lines in one
pass of its regular expression (see `functions.matching`).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake import schema
from lintlake.functions import matching
from lintlake.functions import severity as sev
from lintlake.functions import text as txt
from lintlake.rules import RuleSet, builtin_rules
from lintlake.sources.store import keep

#: Rules that a counting scan writes into its expression; a larger set is joined as a table.
WRITTEN_OUT = 256

_COUNT = "struct<ord:int,matches:bigint>"


def bind(value: Column, use) -> Column:
    """`use(value)`, with the value computed once however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def _contains_any(strings: Column) -> Column:
    return F.exists(strings, lambda s: F.contains(F.col("folded"), s))


def _candidates(only: Column | None = None) -> Column:
    """The rules of the file's language, or those of them at some positions, whose needed
    strings all occur."""
    open_groups = F.filter(
        "groups", lambda group: (F.size(group["gate"]) == 0) | _contains_any(group["gate"])
    )
    checks = F.flatten(F.transform(open_groups, lambda group: group["checks"]))
    if only is not None:
        checks = F.filter(checks, lambda check: F.array_contains(only, check["ord"]))
    return F.filter(checks, lambda check: F.forall(check["needs"], _contains_any))


def _marked(check: Column) -> Column:
    """The text with a mark before every match of one rule."""
    text, pattern, until = F.col("text"), check["pattern"], check["until"]
    return F.when(until.isNull(), matching.marked(text, pattern)).otherwise(
        matching.marked_up_to(text, pattern, until)
    )


def _hits(only: Column | None = None) -> Column:
    """The lines the file's rules, or those of them at some positions, match on."""

    def searched(check: Column) -> Column:
        return F.struct(check["ord"].alias("ord"), _marked(check).alias("marked"))

    found = F.filter(
        F.transform(_candidates(only), searched), lambda rule: matching.has_marks(rule["marked"])
    )
    lines = F.transform(found, lambda rule: matching.marked_lines(rule["marked"], ord=rule["ord"]))
    return F.coalesce(F.flatten(lines), F.array())


def _counts() -> Column:
    """How often the file's rules match; a mark is one byte, so lengths tell."""

    def counted(check: Column) -> Column:
        marks = F.octet_length(_marked(check)) - F.octet_length("text")
        return F.struct(
            check["ord"].alias("ord"), F.coalesce(marks, F.lit(0)).cast("bigint").alias("matches")
        )

    found = F.filter(F.transform(_candidates(), counted), lambda rule: rule["matches"] > 0)
    return F.coalesce(found, F.array())


def _counts_written_out(active: RuleSet) -> Column:
    """The same, with every rule in the expression itself.

    Spark compiles a pattern that is a constant once for a task, one from a table again for each
    file and rule. Rules of the same languages and gate share their test. The expression is the
    body of a lambda, so Spark evaluates it as it is and generates no code of its size.
    """
    none, empty = F.lit(None).cast(_COUNT), F.array().cast(f"array<{_COUNT}>")

    def contains_any(folded: Column, strings: list[str]) -> Column:
        return reduce(or_, [F.contains(folded, F.lit(s)) for s in strings])

    def counted(file: Column, check: dict) -> Column:
        text, pattern, until = file["text"], check["pattern"], check["until"]
        if check["folded"]:
            text, (pattern, until) = file["folded"], check["folded"]
        pattern = F.lit(pattern)
        matches = F.regexp_count(text, pattern)
        if until is not None:
            # Nothing behind the last place where a match can end is searched.
            head = F.call_function("regexp_extract", text, F.lit(until), F.lit(0))
            matches = bind(head, lambda h: F.when(h != "", F.regexp_count(h, pattern)))
        needed = [contains_any(file["folded"], strings) for strings in check["needs"]]
        made = F.struct(F.lit(check["ord"]).alias("ord"), matches.cast("bigint").alias("matches"))
        return F.call_function("if", reduce(and_, needed), made, none) if needed else made

    def searched(file: Column) -> Column:
        parts = []
        for (languages, gate), checks in active.by_gate().items():
            found = F.array(*[counted(file, check) for check in checks])
            opens = [contains_any(file["folded"], gate)] if gate else []
            if languages is not None:
                opens.insert(0, file["language"].isin(list(languages)))
            parts.append(F.call_function("if", reduce(and_, opens), found, empty) if opens else found)
        found = F.flatten(F.array(*parts)) if parts else empty
        return F.filter(found, lambda rule: rule["matches"] > 0)

    file = F.struct("language", "folded", "text")
    return F.when(F.col("text").isNotNull(), bind(file, searched)).otherwise(empty)


def scan_files(
    files: DataFrame, rules: RuleSet | None = None, min_severity: str = "info"
) -> DataFrame:
    """One row per file: path, language, number of lines, and the lines rules matched on.

    Works on a batch or a streaming table. Store the result (`store.keep`, or write it)
    when both findings and totals are wanted, so the texts are read once.
    """
    return _scanned(files, _active(rules, min_severity), _hits().alias("hits"))


def count_files(
    files: DataFrame, rules: RuleSet | None = None, min_severity: str = "info"
) -> DataFrame:
    """The scan where no place is asked for: `counts` holds each rule's matches in the file.

    No text is split into lines and no line is made. `metrics.tally` and `rule_counts`, and
    what is made from a tally, take it like the result of `scan_files`.
    """
    active = _active(rules, min_severity)
    if len(active) > WRITTEN_OUT:
        return _scanned(files, active, _counts().alias("counts"))
    prepared = _prepared(files).withColumn("folded", txt.fold_case(F.col("text")))
    return _rows(prepared, _counts_written_out(active).alias("counts"))


def _active(rules: RuleSet | None, min_severity: str) -> RuleSet:
    return (builtin_rules() if rules is None else rules).at_least(min_severity)


def _prepared(files: DataFrame) -> DataFrame:
    return files.select("path", "language", txt.unify_newlines(F.col("text")).alias("text"))


def _scanned(files: DataFrame, active: RuleSet, found: Column) -> DataFrame:
    return _rows(_with_checks(_prepared(files), active), found)


def _rows(prepared: DataFrame, found: Column) -> DataFrame:
    lines = F.coalesce(txt.line_count(F.col("text")), F.lit(0))
    return prepared.select("path", "language", lines.alias("lines"), found)


def _with_checks(texts: DataFrame, active: RuleSet) -> DataFrame:
    """Texts with unified newlines beside the rules of their language."""
    text = F.col("text")
    keyed = texts.withColumns(
        {
            "folded": txt.fold_case(text),
            "check_key": active.check_key(F.col("language"), text),
        }
    )
    return keyed.join(F.broadcast(active.by_language(texts.sparkSession)), "check_key")


def hit_rows(scanned: DataFrame) -> DataFrame:
    """One slim row per file, rule and line with matches: no rule text, and the line only
    once however many matches start on it."""
    return (
        # Spark infers size(hits) > 0 for an inner explode and would scan twice for it.
        scanned.select(F.col("path").alias("file_path"), F.inline_outer("hits"))
        .where("ord IS NOT NULL")
        .withColumnRenamed("ord", "rule_ord")
    )


def each_match(hits: DataFrame) -> DataFrame:
    """One row per match instead, `match_ord` counting those on one line."""
    return hits.withColumn("match_ord", F.explode(F.sequence(F.lit(1), "matches"))).drop("matches")


def rank(hits: DataFrame, rules: RuleSet) -> DataFrame:
    """Add `severity_rank`, the first sort key."""
    ranks = rules.table(hits.sparkSession).select(
        F.col("ord").alias("rule_ord"), sev.severity_rank(F.col("severity")).alias("severity_rank")
    )
    return hits.join(F.broadcast(ranks), "rule_ord")


def describe(hits: DataFrame, rules: RuleSet) -> DataFrame:
    """Join the rules' own columns to slim rows."""
    table = rules.table(hits.sparkSession).drop(*schema.RULE_INTERNALS)
    return hits.join(F.broadcast(table), hits["rule_ord"] == table["ord"]).drop("ord")


_FINDING = [
    *schema.FINDING_COLUMNS,
    *[c for c in schema.ORDER_COLUMNS if c not in schema.FINDING_COLUMNS],
]


def findings(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """One row per match, with the rule's columns, in no particular order."""
    rules = builtin_rules() if rules is None else rules
    ranks = sev.severity_rank(F.col("severity"))
    described = describe(each_match(hit_rows(scanned)), rules)
    return described.withColumn("severity_rank", ranks).select(_FINDING)


def ordered_findings(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Findings by severity, path and line; ties in rule order, then match order.

    Slim rows are range-partitioned on the order, described there, sorted in place and
    only then repeated for each match, so neither rule text nor copies of a line are
    shuffled. (A join above a global sort would drop the sort.) The rebalance keeps the
    range sampling from running the scan a second time; the line's hash spreads the rows of
    files that share one path.
    """
    rules = builtin_rules() if rules is None else rules
    order = [*[c for c in schema.ORDER_COLUMNS if c != "match_ord"], "line_hash"]
    hashed = hit_rows(scanned).withColumn("line_hash", F.xxhash64("line_content"))
    slim = rank(hashed.hint("rebalance"), rules)
    placed = describe(slim.repartitionByRange(*order), rules).sortWithinPartitions(*order)
    return each_match(placed).select(_FINDING)


def positioned_findings(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Findings with `position`: their place, from 1, in the order of `ordered_findings`.

    Slim rows are range-partitioned by the order and stored with the number of their range.
    The ranges' sums of matches, one number each, give where each begins; within a range a
    running sum goes on from there. No task gets more than a range. Of findings that are equal
    in the whole order, as in files that share a path, either may come first.
    """
    rules = builtin_rules() if rules is None else rules
    order = [*[c for c in schema.ORDER_COLUMNS if c != "match_ord"], "line_hash"]
    hashed = hit_rows(scanned).withColumn("line_hash", F.xxhash64("line_content"))
    slim = rank(hashed.hint("rebalance"), rules)
    placed = keep(slim.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    sums = placed.groupBy("slice").agg(F.sum("matches").alias("matches")).orderBy("slice").collect()
    begins, before = [], 0
    for row in sums:  # a number for each range
        begins.append((row["slice"], before))
        before += row["matches"]
    starts = scanned.sparkSession.createDataFrame(begins, "slice int, before bigint")
    earlier = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("matches").over(earlier), F.lit(0))
    numbered = (
        placed.join(F.broadcast(starts), "slice")
        .withColumn("position", F.col("before") + within)
        .drop("slice", "before")
    )
    each = each_match(describe(numbered, rules))
    return each.withColumn("position", F.col("position") + F.col("match_ord")).select(*_FINDING, "position")


def scan(
    files: DataFrame, rules: RuleSet | None = None, min_severity: str = "info"
) -> DataFrame:
    """Files to findings."""
    return findings(scan_files(files, rules, min_severity), rules)
