"""Reports as rows of lines: JSON, SARIF, Markdown, plain text and a step summary.

A report of a large scan does not fit in one string, so each is a table with a `line`
column in report order, written by many tasks; the part files joined in name order are the
report. Slim rows are range-partitioned and the rules' text is added after that shuffle.

A report reads the scan twice, so pass a stored one (`store.keep`): once for the totals, a row
for each rule and language, which are stored when the report is made, and once for its lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import lintlake
from lintlake import schema
from lintlake.functions import severity as sev
from lintlake.functions import text
from lintlake.operators import metrics
from lintlake.operators.scan import hit_rows, rank
from lintlake.rules import RuleSet, builtin_rules
from lintlake.sources.store import keep

TOOL = "lintlake"

# What findings are ordered by. The line's hash spreads files that share one path.
_FINDING_KEYS = [*[c for c in schema.ORDER_COLUMNS if c != "match_ord"], "line_hash"]
_HEAD, _BODY, _FOOT = 0, 1, 2

# The reports' rule lines, marks and schema address; so are the headings and
# labels in the functions below.
_RULE = "─" * 60
_MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
_STEP_MARKS = {
    "critical": (":red_circle: Critical", "**"),
    "high": (":orange_circle: High", "**"),
    "medium": (":yellow_circle: Medium", ""),
    "low": (":large_blue_circle: Low", ""),
}
_SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
)

_ROW = {
    "section": "int",
    "file_path": "string",
    "part": "int",
    "severity_rank": "int",
    "line_number": "int",
    "rule_ord": "int",
    "line_hash": "bigint",
    "matches": "int",
    "seq": "int",
    "line": "string",
    "line_content": "string",
}


_INTERNAL = ["line_content", "line_hash", "matches", "line"]


def _rows(source: DataFrame, **columns: Column | int | str) -> DataFrame:
    """Report rows, NULL in every column not given."""
    made = []
    for name, kind in _ROW.items():
        value = columns.get(name)
        value = value if isinstance(value, Column) else F.lit(value)
        made.append(value.cast(kind).alias(name))
    return source.select(made)


def _in_section(section: int, lines: Column) -> Column:
    return F.transform(
        lines, lambda line: F.struct(F.lit(section).alias("section"), line.alias("line"))
    )


def _lines(source: DataFrame, head: Column, foot: Column) -> DataFrame:
    """One row per line above and below the findings, from one row; NULL lines are left out."""
    numbered = F.concat(
        *[
            _in_section(section, lines) for section, lines in ((_HEAD, head), (_FOOT, foot))
        ]
    )
    rows = source.select(F.posexplode(numbered).alias("seq", "row")).where("row.line IS NOT NULL")
    return _rows(rows, section=F.col("row.section"), seq=F.col("seq"), line=F.col("row.line"))


def _findings(ranked: DataFrame, part: Column | int = 1) -> DataFrame:
    """One row per line with matches; `_lay_out` repeats it for each of them."""
    columns = [*_FINDING_KEYS, "matches", "line_content"]
    return _rows(ranked, section=_BODY, part=part, **{name: F.col(name) for name in columns})


def _lay_out(parts: list[DataFrame], order: list[str], rules: RuleSet, render: Column) -> DataFrame:
    """Put rows in order, repeat them for each match, and render those without a line."""
    # The rebalance keeps the range sampling from reading the scan once more.
    gathered = reduce(DataFrame.unionByName, parts).hint("rebalance")
    placed = gathered.repartitionByRange(*order)
    table = rules.table(placed.sparkSession).drop(*schema.RULE_INTERNALS)
    table = table.withColumnRenamed("ord", "table_ord")
    each = F.explode(F.sequence(F.lit(1), F.coalesce("matches", F.lit(1))))
    # Numbers rows equal in all keys, which are copies of one file under one path. The range
    # partitioning serves the window, so nothing is shuffled for it.
    copies = Window.partitionBy(*order).orderBy(order[0])
    return (
        placed.join(F.broadcast(table), F.col("rule_ord") == F.col("table_ord"), "left")
        .withColumn("copy", F.row_number().over(copies))
        # Lines about a file are made for each of several files under one path.
        .where("matches IS NOT NULL OR copy = 1")
        .sortWithinPartitions(*order)
        .withColumn("nth", each)
        .withColumn("match_ord", F.when(F.col("matches").isNotNull(), F.col("nth")))
        .withColumn("line", F.coalesce("line", render))
        .select(*[c for c in _ROW if c not in _INTERNAL], "match_ord", "line")
    )


_BY_FINDING = ["section", *_FINDING_KEYS, "seq"]
_BY_FILE = ["section", "file_path", "part", *[k for k in _FINDING_KEYS if k != "file_path"], "seq"]


def _ranked(scanned: DataFrame, rules: RuleSet) -> DataFrame:
    return rank(hit_rows(scanned).withColumn("line_hash", F.xxhash64("line_content")), rules)


def _totals(scanned: DataFrame, rules: RuleSet) -> DataFrame:
    """`metrics.tally` with `first`, the keys of each rule's first finding, in one pass.

    A file's matches of a rule are summed within its row.
    """
    entries = F.expr(
        "concat(array(named_struct('language', language, 'ord', cast(null as int), 'files', 1L, "
        "'lines', lines, 'findings', 0L, 'place', cast(null as struct<line_number:int,line_hash:bigint>))), "
        "transform(array_distinct(hits.ord), o -> named_struct('language', cast(null as string), "
        "'ord', o, 'files', 0L, 'lines', 0L, "
        "'findings', aggregate(filter(hits, h -> h.ord = o), 0L, (n, h) -> n + h.matches), "
        "'place', array_min(transform(filter(hits, h -> h.ord = o), "
        "h -> named_struct('line_number', h.line_number, 'line_hash', xxhash64(h.line_content)))))))"
    )
    place = F.when(
        F.col("ord").isNotNull(),
        F.struct(F.col("path").alias("file_path"), "place.line_number", "place.line_hash"),
    )
    counted = (
        scanned.select("path", F.inline_outer(entries))
        .groupBy("language", "ord")
        .agg(
            *[F.sum(c).alias(c) for c in ("files", "lines", "findings")],
            F.min(place).alias("place"),
            metrics.few_groups("ord"),
        )
        .withColumn("ord", F.get("_group", F.lit(0)))
        .drop("_group")
    )
    table = rules.table(scanned.sparkSession).drop(*schema.RULE_INTERNALS)
    rank_ = sev.severity_rank(F.col("severity")).alias("severity_rank")
    first = F.struct(
        rank_, "place.file_path", "place.line_number", F.col("ord").alias("rule_ord"), "place.line_hash"
    )
    described = counted.join(F.broadcast(table), "ord", "left")
    return keep(described.withColumn("first", F.when(F.col("rule_id").isNotNull(), first)).drop("place"))


def _separated(ranked: DataFrame, totals: DataFrame) -> DataFrame:
    """Finding rows with `part` 1 for the first of all, 2 for the others."""
    first = totals.agg(F.min("first").alias("first")).select("first.*").withColumn("is_first", F.lit(True))
    marked = ranked.join(F.broadcast(first), _FINDING_KEYS, "left")
    return _findings(marked, F.when(F.col("is_first"), 1).otherwise(2))


def _by_file(scanned: DataFrame, rules: RuleSet, above: Column, below: Column | None = None) -> DataFrame:
    """Rows of each file with findings: a line above them, they, a line below, in one pass."""

    def line(part: int, made: Column) -> Column:
        none = {name: F.lit(None).cast(kind) for name, kind in _ROW.items()}
        given = none | {"part": F.lit(part), "line": made}
        return F.struct(*[given[c].alias(c) for c in columns])

    def finding(hit: Column) -> Column:
        given = {
            "part": F.lit(1), "rule_ord": hit["ord"], "line_number": hit["line_number"],
            "matches": hit["matches"].cast("int"), "line_content": hit["line_content"],
            "line_hash": F.xxhash64(hit["line_content"]), "line": F.lit(None).cast("string"),
        }
        return F.struct(*[given[c].alias(c) for c in columns])

    columns = ["part", "rule_ord", "line_number", "matches", "line_content", "line_hash", "line"]
    rows = [F.array(line(0, above)), F.transform("hits", finding)]
    if below is not None:
        rows.append(F.array(line(2, below)))
    each = (
        scanned.withColumn("file_path", F.col("path"))
        .select("file_path", F.inline_outer(F.when(F.size("hits") > 0, F.concat(*rows))))
        .where("part IS NOT NULL")
    )
    ranks = rules.table(scanned.sparkSession).select(
        F.col("ord").alias("rule_ord"), sev.severity_rank(F.col("severity")).alias("severity_rank")
    )
    ranked = each.join(F.broadcast(ranks), "rule_ord", "left")
    given = ["file_path", "part", "severity_rank", "line_number", "rule_ord", "line_hash", "matches", "line", "line_content"]
    return _rows(ranked, section=_BODY, **{name: F.col(name) for name in given})


def _comma(rendered: Column) -> Column:
    """A comma before every finding but the very first."""
    opening = (F.col("part") == 1) & (F.col("copy") == 1) & (F.col("nth") == 1)
    return F.concat(F.when(opening, "").otherwise(","), rendered)


def finding_json() -> Column:
    """One finding as JSON: the line stripped, `cwe_id` only if there is one."""
    return F.to_json(
        F.struct(
            "rule_id",
            "title",
            "description",
            "severity",
            "category",
            "file_path",
            "line_number",
            text.strip(F.col("line_content")).alias("line_content"),
            "suggestion",
            "confidence",
            F.nullif("cwe_id", F.lit("")).alias("cwe_id"),
        )
    )


def json_report(
    scanned: DataFrame,
    rules: RuleSet | None = None,
    path: str = ".",
    scan_duration_ms: float = 0.0,
) -> DataFrame:
    """The whole scan as one JSON object, a line per finding."""
    rules = builtin_rules() if rules is None else rules
    totals = _totals(scanned, rules)
    summary = metrics.summary(totals, path, scan_duration_ms)
    head = F.to_json(
        F.struct(
            F.lit(lintlake.__version__).alias("version"),
            "path",
            "files_scanned",
            "files_skipped",
            "lines_scanned",
            "scan_duration_ms",
            "total_findings",
            "severity_counts",
            "category_counts",
            "language_stats",
        )
    )
    opened = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"findings":['))
    parts = [
        _lines(summary, F.array(opened), F.array(F.lit("]}"))),
        _separated(_ranked(scanned, rules), totals),
    ]
    return _lay_out(parts, _BY_FINDING, rules, _comma(finding_json()))


def sarif_result() -> Column:
    """One finding as a SARIF result; `fixes` only if there is a suggestion."""
    fix = F.array(F.struct(F.struct(F.col("suggestion").alias("text")).alias("description")))
    location = F.struct(
        F.struct(
            F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"),
            F.struct(F.col("line_number").alias("startLine")).alias("region"),
        ).alias("physicalLocation")
    )
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            sev.sarif_level(F.col("severity")).alias("level"),
            F.struct(F.col("description").alias("text")).alias("message"),
            F.array(location).alias("locations"),
            F.when(F.col("suggestion") != "", fix).alias("fixes"),
        )
    )


def sarif_rule() -> Column:
    """A rule as SARIF describes it; `properties.cwe` only if there is one."""
    cwe = F.nullif("cwe_id", F.lit(""))
    return F.struct(
        F.col("rule_id").alias("id"),
        F.col("title").alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(F.col("description").alias("text")).alias("fullDescription"),
        F.struct(sev.sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
        F.when(cwe.isNotNull(), F.struct(cwe.alias("cwe"))).alias("properties"),
    )


def sarif_rules(scanned: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """The rules with findings as (first place, SARIF rule), one for an id, that of its first
    finding."""
    return _hit_rules(_totals(scanned, builtin_rules() if rules is None else rules))


def _hit_rules(totals: DataFrame) -> DataFrame:
    of_id = F.min(F.struct("first", sarif_rule().alias("rule"))).alias("hit")
    return totals.where("rule_id IS NOT NULL").groupBy("rule_id").agg(of_id).select("hit.*")


def sarif_report(
    scanned: DataFrame,
    rules: RuleSet | None = None,
    tool: str = TOOL,
    information_uri: str | None = None,
) -> DataFrame:
    """The scan as SARIF 2.1.0, a line per result."""
    rules = builtin_rules() if rules is None else rules
    totals = _totals(scanned, rules)
    # Bounded: one entry per rule.
    hit = _hit_rules(totals).agg(
        F.array_sort(F.collect_list(F.struct("first", F.to_json("rule").alias("rule")))).alias("hit")
    )
    driver = F.to_json(
        F.struct(
            F.lit(tool).alias("name"),
            F.lit(lintlake.__version__).alias("version"),
            F.lit(information_uri).cast("string").alias("informationUri"),
        )
    )
    opened = F.concat(
        F.lit(f'{{"$schema":"{_SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":'),
        F.regexp_replace(driver, r"\}\z", ""),
        F.lit(',"rules":['),
        F.array_join(F.col("hit.rule"), ","),
        F.lit(']}},"results":['),
    )
    parts = [
        _lines(hit, F.array(opened), F.array(F.lit("]}]}"))),
        _separated(_ranked(scanned, rules), totals),
    ]
    return _lay_out(parts, _BY_FINDING, rules, _comma(sarif_result()))


def _thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def _pad(value: Column, width: int) -> Column:
    """Padded on the right, never cut."""
    value = value.cast("string")
    return F.rpad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))


def _pad_left(value: Column, width: int) -> Column:
    value = value.cast("string")
    return F.lpad(value, F.greatest(F.length(value), F.lit(width)), F.lit(" "))


def _milliseconds() -> Column:
    return F.concat(F.bround("scan_duration_ms", 0).cast("bigint").cast("string"), F.lit("ms"))


def _text(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


def _where_found(line: Column) -> Column:
    return F.when(F.col("total_findings") > 0, line)


def _where_clean(line: str) -> Column:
    return F.when(F.col("total_findings") == 0, line)


def markdown_report(
    scanned: DataFrame,
    rules: RuleSet | None = None,
    path: str = ".",
    scan_duration_ms: float = 0.0,
    show_fix: bool = False,
    tool: str = TOOL,
) -> DataFrame:
    rules = builtin_rules() if rules is None else rules
    summary = metrics.summary(_totals(scanned, rules), path, scan_duration_ms)
    counts = [
        F.when(
            metrics.severity_count(s) > 0,
            _text(f"| {mark} {s.upper()} | ", metrics.severity_count(s), " |"),
        )
        for s, mark in _MARKS.items()
    ]
    head = F.array(
        F.lit(f"# {tool} Security Report"),
        F.lit(""),
        _text("**Path:** `", F.col("path"), "`  "),
        _text("**Files scanned:** ", F.col("files_scanned"), "  "),
        _text("**Lines scanned:** ", _thousands(F.col("lines_scanned")), "  "),
        _text("**Scan time:** ", _milliseconds(), "  "),
        F.lit(""),
        _text("## Security Score: ", F.col("score"), "/100 (Grade: ", F.col("grade"), ")"),
        F.lit(""),
        F.lit("## Summary"),
        F.lit(""),
        F.lit("| Severity | Count |"),
        F.lit("|----------|-------|"),
        *counts,
        F.lit(""),
        _where_clean("**No issues found!** ✅"),
        _where_found(F.lit("## Findings")),
        _where_found(F.lit("")),
    )
    foot = F.array(
        _where_found(F.lit("---")),
        _where_found(F.lit(f"*Generated by {tool} v{lintlake.__version__}*")),
    )
    path_line = _text("### `", F.col("file_path"), "`\n")
    marks = F.create_map(*[F.lit(x) for pair in _MARKS.items() for x in pair])
    line = _text(
        "- ", marks[F.col("severity")], " **[", F.col("rule_id"), "] ", F.col("title"), "** (L",
        F.col("line_number"), ")\n  - ", F.col("description"),
    )
    if show_fix:
        fix = F.when(F.col("suggestion") != "", _text("\n  - 💡 **Fix:** ", F.col("suggestion")))
        line = F.concat(line, F.coalesce(fix, F.lit("")))
    parts = [_lines(summary, head, foot), _by_file(scanned, rules, path_line, F.lit(""))]
    return _lay_out(parts, _BY_FILE, rules, line)


def text_report(
    scanned: DataFrame,
    rules: RuleSet | None = None,
    path: str = ".",
    scan_duration_ms: float = 0.0,
    show_fix: bool = False,
    tool: str = TOOL,
) -> DataFrame:
    rules = builtin_rules() if rules is None else rules
    summary = metrics.summary(_totals(scanned, rules), path, scan_duration_ms)
    counts = [
        F.when(
            metrics.severity_count(s) > 0,
            _text(f"  {s.upper():10s} ", metrics.severity_count(s)),
        )
        for s in schema.SEVERITIES
    ]
    by_lines = F.expr(
        "transform(array_sort(transform(map_entries(language_stats), e -> struct("
        "-e.value.lines AS negated, e.key AS language, e.value.files AS files, "
        "e.value.lines AS lines))), e -> e)"
    )
    languages = F.transform(
        by_lines,
        lambda e: _text(
            "  ", _pad(e["language"], 15), " ", _pad_left(e["files"], 4), " files  ",
            _pad_left(_thousands(e["lines"]), 8), " lines",
        ),
    )
    some = F.size("language_stats") > 0
    head = F.concat(
        F.array(
            F.lit(f"\n{tool} v{lintlake.__version__} — Code Security Scanner"),
            F.lit(_RULE),
            _text("  Path:    ", F.col("path")),
            _text("  Files:   ", F.col("files_scanned"), " scanned, ", F.col("files_skipped"),
                  " skipped"),
            _text("  Lines:   ", _thousands(F.col("lines_scanned"))),
            _text("  Time:    ", _milliseconds()),
            F.lit(""),
            F.when(some, "Languages:"),
        ),
        languages,
        F.array(
            F.when(some, ""),
            _text("Findings: ", F.col("total_findings"), " total"),
            *counts,
            F.lit(""),
            _where_clean("  No issues found. Your code looks clean!"),
            _where_clean(""),
            _where_found(F.lit(_RULE)),
        ),
    )
    foot = F.array(
        _where_found(F.lit(f"\n{_RULE}")),
        _where_found(
            _text("\nSecurity Score: ", F.col("score"), "/100 (Grade: ", F.col("grade"), ")")
        ),
        _where_found(F.lit("")),
    )
    line = _text(
        "  ", _pad(F.upper("severity"), 8), "  L", _pad(F.col("line_number"), 5), " [",
        F.col("rule_id"), "] ", F.col("title"), "\n           ",
        text.snippet(F.col("line_content")),
    )
    if show_fix:
        fix = F.when(F.col("suggestion") != "", _text("\n           💡 ", F.col("suggestion")))
        line = F.concat(line, F.coalesce(fix, F.lit("")))
    parts = [_lines(summary, head, foot), _by_file(scanned, rules, _text("\n", F.col("file_path")))]
    return _lay_out(parts, _BY_FILE, rules, line)


# What a report in JSON says of a finding; `cwe_id` is there only if it has one.
_IN_JSON = ", ".join(
    f"{name} {'int' if name == 'line_number' else 'string'}" for name in schema.FINDING_COLUMNS
)


def read_findings(report: DataFrame) -> DataFrame:
    """The findings of a JSON report, read back from its lines (a column `line` or `value`).

    Every line is taken by itself, so a report of any size is read in parallel: one that starts
    an object with a rule's id, after a comma or not, is a finding. A report that another
    program has laid out anew, with all in one line or a finding over several, is read by
    `read_any_findings`. Lines that are no JSON of a finding are passed over.
    """
    line = F.col("line" if "line" in report.columns else "value")
    found = F.from_json(F.ltrim(line, F.lit(", \t")), _IN_JSON)
    return report.select(found.alias("f")).where("f.rule_id IS NOT NULL").select("f.*")


def read_any_findings(spark, path: str) -> DataFrame:
    """The findings of JSON reports in any layout; each file is one document and one task."""
    layout = f"findings array<struct<{', '.join(part.replace(' ', ':', 1) for part in _IN_JSON.split(', '))}>>"
    documents = spark.read.schema(layout).option("multiLine", True).json(path)
    return documents.select(F.inline("findings")).where("rule_id IS NOT NULL")


def step_summary(summary_row: DataFrame, tool: str = TOOL) -> DataFrame:
    """The short table of a workflow step, from a summary row."""
    counts = [
        F.when(
            metrics.severity_count(s) > 0,
            _text(f"| {label} | {bold}", metrics.severity_count(s), f"{bold} |"),
        )
        for s, (label, bold) in _STEP_MARKS.items()
    ]
    lines = F.array(
        F.lit(f"## {tool} Security Scan Results"),
        F.lit(""),
        F.lit("| Metric | Value |"),
        F.lit("|--------|-------|"),
        _text("| Security Score | **", F.col("score"), "/100** (Grade: ", F.col("grade"), ") |"),
        _text("| Total Findings | ", F.col("total_findings"), " |"),
        *counts,
        F.lit(""),
    )
    none = F.array().cast("array<string>")
    return _lines(summary_row, lines, none).select("seq", "line").sortWithinPartitions("seq")


def write_report(report: DataFrame, path: str, format: str = "text") -> None:
    """Write a report's lines as text in order, or any table as JSON or Parquet."""
    if format == "text":
        report.select("line").write.mode("overwrite").text(path)
    elif format in ("json", "parquet"):
        report.write.mode("overwrite").format(format).save(path)
    else:
        raise ValueError(f"unknown report format: {format}")
