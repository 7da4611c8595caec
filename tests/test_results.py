"""Totals, score, reports, comparison, names, stream."""

import json

import pytest
from pyspark.sql import functions as F

from lintlake import RuleSet, __version__, count_files, findings, from_table, ordered_findings, scan, scan_files
from lintlake.functions import severity as sev
from lintlake.operators import compare, metrics, surface
from lintlake.plans import reports
from lintlake.rules import RULES, builtin_rules
from lintlake.sources.store import keep
from lintlake.streaming.scan import scan_available
from tests.helpers import brute_force, files_table
from tests.test_scan import MIXED

BY_ID = {rule.rule_id: rule for rule in RULES}


@pytest.fixture(scope="module")
def scanned(spark):
    return keep(scan_files(files_table(spark, MIXED)))


@pytest.fixture(scope="module")
def clean(spark):
    return keep(scan_files(files_table(spark, [("a.py", "python", "x = 1\n")])))


def text_of(report):
    return "\n".join(row["line"] for row in report.collect())


# Totals


def test_summary(scanned):
    row = metrics.summary(metrics.tally(scanned), "/src", 12.346).first()
    expected = brute_force(MIXED)
    severities = [BY_ID[e[5]].severity for e in expected]
    categories = [BY_ID[e[5]].category for e in expected]
    assert row["path"] == "/src" and row["scan_duration_ms"] == 12.35
    assert (row["files_scanned"], row["files_skipped"], row["lines_scanned"]) == (7, 0, 17)
    assert row["total_findings"] == len(expected)
    assert row["severity_counts"] == {s: severities.count(s) for s in set(severities)}
    assert row["category_counts"] == {c: categories.count(c) for c in set(categories)}
    stats = {k: (v["files"], v["lines"]) for k, v in row["language_stats"].items()}
    assert stats == {"python": (6, 14), "javascript": (1, 3)}
    assert row["blocking"] == sum(s in ("critical", "high") for s in severities)


def test_findings_metrics(scanned):
    tallied = metrics.tally(scanned)
    row = metrics.summary(tallied).first()
    assert dict(metrics.severity_counts(tallied).collect()) == row["severity_counts"]
    assert dict(metrics.category_counts(tallied).collect()) == row["category_counts"]
    counted = metrics.file_counts(scanned)
    assert "sequence" not in counted._jdf.queryExecution().toString()
    per_file = {r["file_path"]: r["findings"] for r in counted.collect()}
    assert sum(per_file.values()) == row["total_findings"] and "clean.py" not in per_file
    order = [r["severity"] for r in metrics.severity_table(tallied).collect()]
    assert order == [s for s in ("critical", "high", "medium", "low", "info") if s in order]
    languages = [r["language"] for r in metrics.languages_by_lines(scanned).collect()]
    assert languages == ["python", "javascript"]
    assert [r["language"] for r in metrics.language_stats(scanned).collect()] == sorted(languages)


def test_rules_hit_in_order_of_first_finding(scanned):
    expected = list(dict.fromkeys(e[5] for e in brute_force(MIXED)))
    assert [r["rule_id"] for r in metrics.rules_hit(scanned).collect()] == expected


def python_score(files, lines, cost):
    if files == 0:
        return 100
    return max(0, min(100, round(100 - cost / (1 + max(1, lines / 1000) * 0.1))))


def test_score_like_python(spark):
    cases = [(f, n, c) for f in (0, 1) for n in (0, 1, 999, 1000, 1001, 5000, 12_345, 10_000_000)
             for c in range(0, 260, 1)]
    # Deductions that leave exactly one half: 1 + size / 10 is 2, 3 or 4.
    cases += [(1, n, c) for n in (10_000, 20_000, 30_000) for c in range(1, 400)]
    table = spark.createDataFrame(cases, "files bigint, lines bigint, cost bigint")
    points = metrics.score(F.col("files"), F.col("lines"), F.col("cost"))
    for files, lines, cost, got in table.select("*", points).collect():
        assert got == python_score(files, lines, cost), (files, lines, cost)


def test_grades(spark):
    scores = {100: "A+", 95: "A+", 94: "A", 90: "A", 89: "B+", 80: "B+", 79: "B", 70: "B", 69: "C",
              60: "C", 59: "D", 50: "D", 49: "F", 0: "F"}
    table = spark.createDataFrame([(s,) for s in scores], "score int")
    assert dict(table.select("score", sev.score_to_grade(F.col("score"))).collect()) == scores


def test_parse_severity(spark):
    table = spark.createDataFrame([(" High\n",), ("INFO",), (None,)], "s string")
    parsed = [r[0] for r in table.select(sev.parse_severity(F.col("s"))).collect()]
    assert parsed == ["high", "info", None]
    bad = spark.createDataFrame([("worst",)], "s string")
    with pytest.raises(Exception, match="Invalid severity: worst"):
        bad.select(sev.parse_severity(F.col("s"))).collect()
    assert sev.check_severity(" CRITICAL") == "critical"


@pytest.mark.parametrize(
    ("text", "failing"),
    [("eval(x)", "high medium low"), ("# TODO x", "low"), ("DEBUG = 1", "medium low"),
     ('password = "abcdef"', "critical high medium low"), ("x", "")],
)
def test_gate(spark, text, failing):
    row = metrics.summary(metrics.tally(scan_files(files_table(spark, [("a", "python", text)]))))
    verdicts = dict(metrics.gate(row).collect())
    assert [level for level, fails in verdicts.items() if fails] == failing.split()
    outputs = metrics.caller_outputs(row).first()
    assert outputs["total"] == (1 if failing else 0) and outputs["grade"] is not None


# Reports


def as_json(row):
    rank, path, line, position, _, rule_id, content = row
    rule = BY_ID[rule_id]
    made = {
        "rule_id": rule_id, "title": rule.title, "description": rule.description,
        "severity": rule.severity, "category": rule.category, "file_path": path,
        "line_number": line, "line_content": content.strip(), "suggestion": rule.suggestion,
        "confidence": rule.confidence,
    }
    return made | ({"cwe_id": rule.cwe_id} if rule.cwe_id else {})


def test_json_report(scanned):
    report = json.loads(text_of(reports.json_report(scanned, path="/src", scan_duration_ms=3.0)))
    assert report["findings"] == [as_json(row) for row in brute_force(MIXED)]
    assert list(report) == [
        "version", "path", "files_scanned", "files_skipped", "lines_scanned", "scan_duration_ms",
        "total_findings", "severity_counts", "category_counts", "language_stats", "findings",
    ]
    assert report["version"] == __version__ and report["files_scanned"] == 7
    assert report["language_stats"]["python"] == {"files": 6, "lines": 14}


def test_sarif_report(scanned):
    report = json.loads(text_of(reports.sarif_report(scanned, information_uri="https://x.org")))
    assert report["version"] == "2.1.0" and "sarif-schema-2.1.0" in report["$schema"]
    run = report["runs"][0]
    expected = brute_force(MIXED)
    assert run["tool"]["driver"]["informationUri"] == "https://x.org"
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == list(
        dict.fromkeys(e[5] for e in expected)
    )
    assert [r["ruleId"] for r in run["results"]] == [e[5] for e in expected]
    by_id = {r["id"]: r for r in run["tool"]["driver"]["rules"]}
    assert by_id["SEC001"]["properties"] == {"cwe": "CWE-798"}
    assert by_id["SEC001"]["defaultConfiguration"] == {"level": "error"}
    assert "properties" not in by_id["QUA001"]
    first = run["results"][0]
    place = first["locations"][0]["physicalLocation"]
    assert place == {"artifactLocation": {"uri": expected[0][1]}, "region": {"startLine": expected[0][2]}}
    assert first["fixes"][0]["description"]["text"] == BY_ID[expected[0][5]].suggestion


def test_reports_of_a_clean_scan(clean):
    assert json.loads(text_of(reports.json_report(clean)))["findings"] == []
    run = json.loads(text_of(reports.sarif_report(clean)))["runs"][0]
    assert run["results"] == [] and run["tool"]["driver"]["rules"] == []
    assert text_of(reports.markdown_report(clean)).endswith("\n\n**No issues found!** ✅")
    plain = text_of(reports.text_report(clean))
    assert plain.endswith("Findings: 0 total\n\n  No issues found. Your code looks clean!\n")
    assert "Score" not in plain


def expected_markdown(rows, show_fix):
    marks = dict(zip(["critical", "high", "medium", "low", "info"], "🔴🟠🟡🔵⚪"))
    lines = []
    for path in sorted({r[1] for r in rows}):
        lines += [f"### `{path}`", ""]
        for row in [r for r in rows if r[1] == path]:
            rule = BY_ID[row[5]]
            lines.append(f"- {marks[rule.severity]} **[{row[5]}] {rule.title}** (L{row[2]})")
            lines.append(f"  - {rule.description}")
            if show_fix:
                lines.append(f"  - 💡 **Fix:** {rule.suggestion}")
        lines.append("")
    return "\n".join(lines)


@pytest.mark.parametrize("show_fix", [False, True])
def test_markdown_report(scanned, show_fix):
    report = text_of(reports.markdown_report(scanned, path="/src", scan_duration_ms=2.5, show_fix=show_fix))
    body = expected_markdown(brute_force(MIXED), show_fix)
    assert f"\n## Findings\n\n{body}\n---\n*Generated by" in report
    assert report.startswith("# lintlake Security Report\n\n**Path:** `/src`  \n**Files scanned:** 7  \n")
    assert "**Scan time:** 2ms  \n\n## Security Score: " in report


def test_text_report(scanned):
    report = text_of(reports.text_report(scanned, path="/src", show_fix=True))
    lines = []
    rows = brute_force(MIXED)
    for path in sorted({r[1] for r in rows}):
        lines += ["", path]
        for row in [r for r in rows if r[1] == path]:
            rule = BY_ID[row[5]]
            lines.append(f"  {rule.severity.upper():8s}  L{row[2]:<5d} [{row[5]}] {rule.title}")
            lines.append(f"           {row[6].strip()[:80]}")
            lines.append(f"           💡 {rule.suggestion}")
    body = "\n".join(lines)
    bar = "─" * 60
    assert f"{bar}\n{body}\n\n{bar}\n\nSecurity Score: " in report
    assert "Languages:\n  python             6 files        14 lines\n  javascript         1 files" in report
    assert report.startswith(f"\nlintlake v{__version__} — Code Security Scanner\n{bar}\n  Path:    /src\n")


def test_report_layout(spark, scanned):
    """The rules' text and the lines are added after the one range shuffle."""
    plan = reports.json_report(scanned)._jdf.queryExecution().toString().split("Physical Plan")[1]
    top = plan.split("Exchange rangepartitioning")[0]
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange" not in top.split("Broadcast")[0]
    assert "Window" in top and "hashpartitioning(section" not in plan


def test_step_summary(scanned):
    lines = text_of(reports.step_summary(metrics.summary(metrics.tally(scanned)))).split("\n")
    assert lines[:4] == ["## lintlake Security Scan Results", "", "| Metric | Value |", "|--------|-------|"]
    assert any(line.startswith("| :red_circle: Critical | **") for line in lines) and lines[-1] == ""


def test_write_report(spark, scanned, tmp_path):
    report = reports.markdown_report(scanned)
    reports.write_report(report, str(tmp_path / "md"))
    parts = sorted((tmp_path / "md").glob("part-*"))
    written = "".join(part.read_text() for part in parts)
    assert written == text_of(report) + "\n"
    reports.write_report(findings(scanned), str(tmp_path / "rows"), "parquet")
    assert spark.read.parquet(str(tmp_path / "rows")).count() == len(brute_force(MIXED))
    reports.write_report(findings(scanned), str(tmp_path / "json"), "json")
    with pytest.raises(ValueError, match="unknown report format"):
        reports.write_report(report, str(tmp_path / "x"), "xml")


def test_reports_of_files_that_share_a_path(spark):
    """Copies and different texts under one path: valid JSON, every finding, path once."""
    rows = [("same", "python", text) for text in ["eval(x)\neval(y)"] * 40 + ["eval(z)", "eval(z) "]]
    scanned = keep(scan_files(files_table(spark, rows)))
    report = json.loads(text_of(reports.json_report(scanned)))
    assert len(report["findings"]) == 82 == report["total_findings"]
    assert len(json.loads(text_of(reports.sarif_report(scanned)))["runs"][0]["results"]) == 82
    assert text_of(reports.markdown_report(scanned)).count("### `same`") == 1
    assert ordered_findings(scanned).count() == 82


def test_report_with_few_rules(spark):
    """Positions in a filtered rule set stay those of the full one."""
    rules = builtin_rules().only(rule_ids=["QUA001", "SEC003"])
    rows = [row for row in brute_force(MIXED) if row[5] in ("QUA001", "SEC003")]
    scanned = keep(scan_files(files_table(spark, MIXED), rules))
    report = json.loads(text_of(reports.json_report(scanned, rules)))
    assert report["findings"] == [as_json(row) for row in rows]
    assert [tuple(r) for r in ordered_findings(scanned, rules).select("rule_id", "rule_ord").collect()] == [
        (row[5], row[3]) for row in rows
    ]


@pytest.mark.parametrize("made", [reports.json_report, reports.sarif_report, reports.markdown_report, reports.text_report])
def test_reports_read_the_scan_twice(scanned, made):
    """Once for the totals, which are stored when the report is made, and once here."""
    plan = made(scanned)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "FileScan" in line and "hits" in line]
    assert len(reads) == 1


# Comparison


def test_compare(spark):
    old = files_table(spark, [("a.py", "python", "eval(x)\npickle.loads(y)"), ("b.py", "python", "eval(z)")])
    new = files_table(spark, [("a.py", "python", "# hi\n  eval(x)  \neval(w)"), ("c.py", "python", "eval(z)")])
    current, baseline = scan_files(new), scan_files(old)
    places = lambda f: sorted((r["file_path"], r["rule_id"], r["line_number"]) for r in f.collect())
    assert places(compare.new_findings(current, baseline)) == [("a.py", "INJ004", 3), ("c.py", "INJ004", 1)]
    assert places(compare.kept_findings(current, baseline)) == [("a.py", "INJ004", 2)]
    assert places(compare.fixed_findings(current, baseline)) == [("a.py", "INJ005", 2), ("b.py", "INJ004", 1)]


def test_compare_ships_slim_rows(spark):
    current = scan_files(files_table(spark, [("a.py", "python", "eval(x) " * 100_000)]))
    baseline = scan_files(files_table(spark, [("a.py", "python", "eval(y)")]))
    new = compare.new_findings(current, baseline)
    plan = new._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    shuffled = [lines[k + 1] for k, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert shuffled and not any("description" in line for line in shuffled)
    # Matches are repeated above the join.
    assert plan.index("explode") < plan.index("LeftAnti") and plan.count("explode") == 1
    assert new.count() == 100_000


def test_marking_suppressions_starts_no_job(spark):
    found = scan_files(files_table(spark, [("a.py", "python", "eval(x)")]))
    table = spark.createDataFrame([("INJ004", None, None, "r")], "rule_id string, file_path string, expires string, reason string")
    spark.sparkContext.setJobGroup("marking", "")
    compare.mark_suppressed(found, table, "2024-05-01")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("marking")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_suppressions(spark):
    found = scan_files(files_table(spark, [(n, "python", "eval(x)\n# TODO x") for n in ("a.py", "b.py")]))
    entries = [
        ("INJ004", "a.py", "2024-05-01", "z"), ("INJ004", "a.py", "2024-05-02", "accepted"),
        ("INJ004", "b.py", "2024-04-30", "expired"), ("QUA001", None, None, None),
        ("SEC001", "a.py", None, "unused"),
    ]
    table = spark.createDataFrame(entries, "rule_id string, file_path string, expires string, reason string")
    marked = compare.mark_suppressed(found, table, "2024-05-01")
    got = {(r["rule_id"], r["file_path"]): r["suppressed_by"] for r in marked.collect()}
    assert got == {("INJ004", "a.py"): "accepted", ("INJ004", "b.py"): None,
                   ("QUA001", "a.py"): "", ("QUA001", "b.py"): ""}
    assert compare.active_findings(found, table, "2024-05-01").count() == 1
    assert compare.suppressed_findings(found, table, "2024-05-01").count() == 3
    assert marked.count() == findings(found).count() and set(findings(found).columns) - {
        "severity_rank"} <= set(marked.columns)


def test_suppressions_ship_slim_rows(spark):
    """No rule text goes through the joins, and nothing is sorted to aggregate the list."""
    found = scan_files(files_table(spark, [("a.py", "python", "eval(x) eval(y)")]))
    table = spark.createDataFrame([("INJ004", "a.py", None, "r")], "rule_id string, file_path string, expires string, reason string")
    for made in (compare.suppressed_findings, compare.active_findings, compare.mark_suppressed):
        plan = made(found, table, "2024-05-01")._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
        for line in plan.splitlines():
            if "Exchange hashpartitioning(rule_id" in line:
                assert "description" not in line
    rows = compare.suppressed_findings(found, table, "2024-05-01").collect()
    assert [(r["match_ord"], r["suppressed_by"], r["title"] != "") for r in sorted(rows)] == [(1, "r", True), (2, "r", True)]


def test_rules_hit_sorts_no_rows(scanned):
    assert "SortAggregate" not in metrics.rules_hit(scanned)._jdf.queryExecution().executedPlan().toString()


def test_counts_without_lines(spark):
    """The counting form gives the tally and the counts of the full scan."""
    rows = [("a.py", "python", "eval(x) eval(y)\r\n# TODO\nasync def f():\n  x\n  open(y)"), ("b.js", "javascript", None),
            ("c.py", "python", ""), ("c.py", None, "password = 'hunter22'")]
    files = files_table(spark, rows)
    full, counted = scan_files(files), count_files(files)
    assert counted.columns == ["path", "language", "lines", "counts"]
    for of in (metrics.tally, metrics.rule_counts):
        assert sorted(map(str, of(full).collect())) == sorted(map(str, of(counted).collect()))
    assert "line_content" not in metrics.rule_counts(counted)._jdf.queryExecution().executedPlan().toString()


# Names


def names(spark, *items):
    return spark.createDataFrame([tuple(i.split(":")) for i in items], "kind string, name string")


@pytest.mark.parametrize(
    ("candidate", "expected"),
    [(["rule:A", "cli:x"], "internal"), (["rule:A", "cli:x", "rule:B"], "additive"),
     (["cli:x"], "breaking"), (["cli:x", "rule:B"], "breaking")],
)
def test_change_class(spark, candidate, expected):
    published = names(spark, "rule:A", "cli:x", "cli:x")
    changed = surface.changes(published, names(spark, *candidate))
    assert surface.change_class(changed).first()["change_class"] == expected
    added = sorted(r["name"] for r in changed.where("change = 'added'").collect())
    assert added == (["B"] if "rule:B" in candidate else [])


def test_qualified_names(spark):
    both = surface.union_names(names(spark, "rule:B", "rule:A"), names(spark, "rule:A", "cli:x"))
    assert [r[0] for r in surface.qualified(both).collect()] == ["cli:x", "rule:A", "rule:B"]


def test_surface_of_rules(spark):
    names_now = surface.of_rules(spark, builtin_rules())
    assert surface.qualified(names_now).count() == 75 + 7 + 5 + 16 + 27 + 4
    fewer = surface.of_rules(spark, RuleSet.of(RULES[1:]))
    changed = surface.changes(names_now, fewer)
    assert [tuple(r) for r in changed.collect()] == [("rule", "SEC001", "removed")]


def test_newest_release(spark):
    def newest(*releases):
        table = spark.createDataFrame(releases, "tag string, version string")
        return [tuple(r) for r in surface.newest_release(table).collect()]

    assert newest(("v1.9.0", "1.9.0"), ("v1.10.0", "1.10.0"), ("v1", "1.10.0")) == [("v1.10.0", "1.10.0")]
    assert newest(("v1", "1.1.0"), ("v1.1.0", "1.1.0")) == [("v1.1.0", "1.1.0")]
    assert newest(("v9.9.9", "1.0.0"), ("v1.0.0", "1.0.0")) == [("v1.0.0", "1.0.0")]
    assert newest(("stable", "2.0.0"), ("latest", "2.0.0")) == [("latest", "2.0.0")]
    assert newest(("v9.9.9", "1.0.0")) == []


# Stream


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    layout = "path string, language string, size bigint, text string"
    files_table(spark, MIXED[:3]).write.parquet(str(source))
    stream = from_table(spark.readStream.schema(layout).parquet(str(source)), "path", "text", F.col("language"))

    def run():
        scan_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(
            (r["file_path"], r["line_number"], r["rule_ord"], r["match_ord"])
            for r in findings(spark.read.parquet(str(tmp_path / "out"))).collect()
        )

    def expected(rows):
        return sorted((r[1], r[2], r[3], r[4]) for r in brute_force(rows))

    assert run() == expected(MIXED[:3])
    files_table(spark, MIXED[3:]).write.mode("append").parquet(str(source))
    assert run() == expected(MIXED)


def test_custom_rules(spark):
    table = spark.createDataFrame(
        [("A1", r"foo\d+", "high", "quality", ["python"]), ("A2", "(", "high", "quality", None)],
        "rule_id string, pattern string, severity string, category string, languages array<string>",
    )
    rules = RuleSet.from_table(table)
    assert [name for name, _, _ in rules.rejected] == ["A2"]
    rows = scan(files_table(spark, [("a", "python", "foo1 FOO22"), ("b", "go", "foo3")]), rules).collect()
    assert [(r["rule_id"], r["file_path"], r["match_ord"]) for r in rows] == [("A1", "a", 1), ("A1", "a", 2)]


def test_custom_rules_are_read_leniently(spark):
    rows = [
        ("B2", "HREF\\d", " HIGH ", "Quality", ["HREF"]), ("B1", "x", "low", "quality", None),
        ("B1", "y", "low", "quality", ["never there"]),
    ]
    table = spark.createDataFrame(rows, "rule_id string, pattern string, severity string, category string, needs array<string>")
    rules = RuleSet.from_table(table.repartition(3))
    assert [(r.rule_id, r.pattern, r.severity, r.category) for r in rules] == [
        ("B1", "x", "low", "quality"), ("B1", "y", "low", "quality"), ("B2", "HREF\\d", "high", "quality")]
    scanned = keep(scan_files(files_table(spark, [("a", "python", "HREF1 y x")]), rules))
    assert sorted(r["rule_id"] for r in findings(scanned, rules).collect()) == ["B1", "B1", "B2"]
    sarif = json.loads(text_of(reports.sarif_report(scanned, rules)))
    assert [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["B2", "B1"]
    assert [(r["rule_id"], r["findings"]) for r in metrics.rules_hit(scanned, rules).collect()] == [("B2", 1), ("B1", 2)]
    with pytest.raises(ValueError, match="more than 10 bytes"):
        RuleSet.from_table(table, max_bytes=10)
    with pytest.raises(ValueError, match="more than 100"):
        scan_files(files_table(spark, []), RuleSet.from_table(table, max_bytes=100))


def test_rule_counts(scanned):
    rows = brute_force(MIXED)
    got = {r["rule_id"]: (r["findings"], r["files"]) for r in metrics.rule_counts(scanned).collect()}
    assert got == {
        name: (sum(r[5] == name for r in rows), len({r[1] for r in rows if r[5] == name}))
        for name in {r[5] for r in rows}
    }
