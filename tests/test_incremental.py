"""Scans from stored ones, positions, baselines from reports, findings on file."""

import json

import pytest
from pyspark.sql import functions as F

from lintlake import RuleSet, count_files, findings, ordered_findings, scan_files
from lintlake.operators import compare, incremental, metrics
from lintlake.operators.scan import positioned_findings
from lintlake.plans import reports
from lintlake.rules import builtin_rules
from lintlake.sources.findings import read_findings, write_findings
from lintlake.sources.store import keep
from tests.helpers import files_table
from tests.test_scan import MIXED

OLD = [
    ("same.py", "python", "eval(x)\n# TODO"), ("edited.py", "python", "eval(x)"), ("gone.js", "javascript", "a == b "),
    ("other.py", "python", "exec(x)"), ("none.py", "python", None), ("empty.py", "python", ""), ("twice.py", "python", "eval(y)"),
    ("twice.py", "python", "eval(y)"), ("less.py", "python", "eval(z)"), ("less.py", "python", "eval(z)"), (None, "python", "eval(n)"),
]
NEW = [
    ("same.py", "python", "eval(x)\r\n# TODO"), ("edited.py", "python", "x = 1\neval(x)"), ("new.py", "python", "password = 'hunter22'"),
    ("other.py", "javascript", "exec(x)"), ("none.py", "python", None), ("empty.py", "python", ""), ("twice.py", "python", "eval(y)"),
    ("twice.py", "python", "eval(y)"), ("less.py", "python", "eval(z)"), (None, "python", "eval(n)"),
]


def rows(table, columns=("path", "language", "lines", "hits")):
    return sorted(map(str, table.select(*columns).collect()))


def test_rescan_is_the_full_scan(spark):
    old, new = files_table(spark, OLD), files_table(spark, NEW).repartition(3)
    stored = keep(incremental.keyed_scan(old))
    assert rows(stored) == rows(scan_files(old))
    changes = incremental.rescan(new, stored)
    assert rows(changes.scanned) == rows(scan_files(new))
    assert {r["path"] for r in changes.added.collect()} == {"edited.py", "new.py", "other.py", "less.py"}
    assert sorted(r["path"] for r in changes.gone.collect()) == ["edited.py", "gone.js", "less.py", "less.py", "other.py"]
    tallied = incremental.adjusted_tally(metrics.tally(stored), changes)
    columns = ["language", "rule_id", "severity", "category", "files", "lines", "findings"]
    assert rows(tallied, columns) == rows(metrics.tally(count_files(new)), columns)
    # What came out can be the stored scan of the next time.
    again = incremental.rescan(new, keep(changes.scanned))
    assert again.added.count() == again.gone.count() == 0 and rows(again.scanned) == rows(scan_files(new))


def test_unchanged_texts_are_not_searched(spark):
    """Hits that were put into the stored scan by hand are still there after a rescan."""
    files = files_table(spark, [(f"f{k}.py", "python", f"eval({k})") for k in range(20)])
    marked = F.transform("hits", lambda h: h.withField("line_content", F.lit("by hand")))
    stored = keep(incremental.keyed_scan(files).withColumn("hits", marked))
    newer = files.withColumn("text", F.when(F.col("path") == "f3.py", "y = eval(33)").otherwise(F.col("text")))
    got = findings(incremental.rescan(newer, stored).scanned)
    assert {r["file_path"] for r in got.where("line_content <> 'by hand'").collect()} == {"f3.py"} and got.count() == 20
    # Under other rules every file has changed.
    only = builtin_rules().only(rule_ids=["INJ004"])
    assert findings(incremental.rescan(files, stored, only).scanned, only).where("line_content = 'by hand'").count() == 0
    assert incremental.rescan(files, stored, min_severity="high").added.count() == 20


def test_rescan_of_nothing(spark):
    files = files_table(spark, OLD)
    none = files.limit(0)
    assert rows(incremental.rescan(files, keep(incremental.keyed_scan(none))).scanned) == rows(scan_files(files))
    assert incremental.rescan(none, keep(incremental.keyed_scan(files))).scanned.count() == 0


def test_positions(spark):
    lines = "\n".join(["eval(x) eval(y) # TODO a TODO b"] * 40)
    files = files_table(spark, [*MIXED, *[(f"p{k % 7}.py", "python", lines) for k in range(12)]])
    scanned = keep(scan_files(files))
    got = positioned_findings(scanned)
    columns = [c for c in got.columns if c not in ("position", "match_ord")]
    placed = [tuple(r[c] for c in columns) for r in got.orderBy("position").collect()]
    assert placed == [tuple(r[c] for c in columns) for r in ordered_findings(scanned).collect()]
    assert sorted(r["position"] for r in got.select("position").collect()) == list(range(1, len(placed) + 1))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert positioned_findings(scanned.limit(0)).count() == 0


def test_a_report_as_baseline(spark, tmp_path):
    old, new = (keep(scan_files(files_table(spark, rows))) for rows in (OLD[:-1], NEW[:-1]))
    place = str(tmp_path / "report")
    reports.write_report(reports.json_report(old), place)
    reported = reports.read_findings(spark.read.text(place))
    plain = findings(old).select(reported.columns)
    assert reported.count() == plain.count()
    assert {(r["rule_id"], r["file_path"], r["line_number"]) for r in reported.collect()} == {
        (r["rule_id"], r["file_path"], r["line_number"]) for r in plain.collect()}
    columns = ["rule_id", "file_path", "line_number", "match_ord"]
    want = sorted(map(str, compare.new_findings(new, old).select(columns).collect()))
    assert sorted(map(str, compare.new_since_report(new, reported).select(columns).collect())) == want and want
    # The same report, laid out by another program.
    text = "".join(r["line"] + "\n" for r in reports.json_report(old).collect())
    for indent in (None, 2):
        (tmp_path / f"laid{indent}.json").write_text(json.dumps(json.loads(text), indent=indent))
        other = reports.read_any_findings(spark, str(tmp_path / f"laid{indent}.json"))
        assert sorted(map(str, other.collect())) == sorted(map(str, reported.collect()))
        assert sorted(map(str, compare.new_since_report(new, other).select(columns).collect())) == want
    assert compare.new_since_report(new, reported.limit(0)).count() == findings(new).count()


@pytest.mark.parametrize(("ids", "categories", "severities"), [
    (["SEC001"], [], {"critical"}), (["QUA001", "INJ004"], [], {"info", "low", "high", "critical"}), ([], ["performance"], {"medium", "low"}),
])
def test_findings_on_file_are_pruned(spark, tmp_path, ids, categories, severities):
    scanned = scan_files(files_table(spark, [*MIXED, *OLD[:-1]]))
    place = str(tmp_path / "findings")
    write_findings(findings(scanned), place)
    got = read_findings(spark, place, ids, categories)
    chosen = builtin_rules().only(ids, categories)
    wanted = {rule.rule_id for rule in chosen}
    assert got.count() == findings(scanned).where(F.col("rule_id").isin(sorted(wanted))).count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "severity" in filters.split("PartitionFilters: [")[1].split("]")[0]
    read = {path.split("severity=")[1].split("/")[0] for path in got.inputFiles()} if got.count() else set()
    assert {rule.severity for rule in chosen} <= severities and read <= {"critical", "high", "medium", "low", "info"}
    assert read_findings(spark, place).count() == findings(scanned).count()
    assert read_findings(spark, place, min_severity="high").where("severity NOT IN ('critical', 'high')").count() == 0
    empty = RuleSet.of([])
    assert read_findings(spark, place, ["SEC001"], rules=empty).count() == findings(scanned).where("rule_id = 'SEC001'").count()
