"""The scan: lines, order, odd files, plans."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lintlake import from_table, findings, ordered_findings, scan, scan_files, schema
from lintlake.operators.metrics import tally
from lintlake.operators.scan import hit_rows
from lintlake.rules import RuleSet, builtin_rules
from tests.helpers import brute_force, files_table, spark_rows

MIXED = [
    ("b.py", "python", 'x = 1\npassword = "hunter42"\n# TODO: a # FIXME b\n'),
    ("a.py", "python", "# TODO one\r\neval(x)\rpassword: 'two\nlines'\r\n"),
    ("a/é.py", "python", 'token = "123456789"; secret = "123456789" # TODO'),
    ("c.js", "javascript", "\n==x\nif (a == b) {}"),
    ("empty.py", "python", ""),
    ("none.py", "python", None),
    ("clean.py", "python", "def add(a, b):\n    return a + b\n"),
]


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_layouts(spark):
    scanned = scan_files(files_table(spark, MIXED))
    assert scanned.schema.simpleString() == StructType.fromDDL(schema.SCANNED).simpleString()
    assert findings(scanned).columns[:11] == schema.FINDING_COLUMNS
    assert findings(scanned).columns == ordered_findings(scanned).columns


def test_lines_and_order(spark):
    scanned = scan_files(files_table(spark, MIXED))
    assert spark_rows(ordered_findings(scanned)) == brute_force(MIXED)
    assert sorted(spark_rows(findings(scanned))) == brute_force(MIXED)


def test_line_counts(spark):
    scanned = scan_files(files_table(spark, MIXED))
    counts = {row["path"]: row["lines"] for row in scanned.collect()}
    assert counts == {
        "b.py": 4, "a.py": 5, "a/é.py": 1, "c.js": 3, "empty.py": 1, "none.py": 0, "clean.py": 3,
    }


@pytest.mark.parametrize("severity", schema.SEVERITIES)
def test_min_severity(spark, severity):
    found = scan(files_table(spark, MIXED), min_severity=severity.upper() + " ")
    assert sorted(spark_rows(found)) == brute_force(MIXED, min_severity=severity)


def test_columns_of_a_finding(spark):
    row = scan(files_table(spark, MIXED[:1])).where("rule_id = 'SEC001'").first()
    assert row["title"] == "Hardcoded password" and row["cwe_id"] == "CWE-798"
    assert row["severity"] == "critical" and row["category"] == "secret"
    assert row["line_number"] == 2 and row["line_content"] == 'password = "hunter42"'
    assert scan(files_table(spark, MIXED)).where("rule_id = 'QUA001'").first()["cwe_id"] is None


def test_no_rules_and_no_files(spark):
    nothing = RuleSet.of([])
    scanned = scan_files(files_table(spark, MIXED), nothing)
    assert scanned.count() == len(MIXED) and findings(scanned, nothing).count() == 0
    assert scan(files_table(spark, [])).count() == 0


def test_long_texts_survive(spark):
    """Loops over many lines, one very long line, very many matches on one line."""
    lines = "x = 1\n" * 20_000
    rows = [
        ("head only", "python", "async def f():\n" + lines + "for x in y:\n" + lines),
        ("head and tail", "python", "async def f():\n" + lines + "open(x)\n" + "for x in y:\n"
         + lines + "  re.sub(a)\n"),
        ("long value", "python", 'password = "' + "a" * 900_000 + '"'),
        ("many", "javascript", "a==b;" * 2_000),
        ("many lines", "javascript", "a==b;\n" * 50_000),
    ]
    found = sorted(spark_rows(scan(files_table(spark, rows))))
    assert found == brute_force(rows)
    assert len(found) == 52_003


def test_many_heads_below_the_last_tail(spark):
    """Linear where a search for each head would not end in reasonable time."""
    heads = "async def f():\n  for x in y:\n" * 60_000
    text = "for x in y:\n  re.sub(a)\nasync def g():\n  open(b)\n" + heads
    found = spark_rows(scan(files_table(spark, [("a.py", "python", text)])))
    assert sorted((row[5], row[2]) for row in found) == [("PRF001", 3), ("PRF003", 1)]


def test_a_line_with_very_many_matches_is_held_once(spark):
    rows = [("min.js", "javascript", "a==b;" * 200_000)]
    scanned = scan_files(files_table(spark, rows))
    assert tally(scanned).agg(F.sum("findings")).first()[0] == 200_000
    hits = hit_rows(scanned).collect()
    assert [(h["line_number"], h["matches"]) for h in hits] == [(1, 200_000)]
    in_order = ordered_findings(scanned).select("match_ord", F.length("line_content").alias("n"))
    assert in_order.agg(F.count("*"), F.max("match_ord"), F.sum("n")).first() == (
        200_000, 200_000, 200_000 * 1_000_000,
    )


def test_one_read_of_the_texts(spark, tmp_path):
    """Text is scanned once, by a hash join with the rules, without a shuffle or Python."""
    files_table(spark, MIXED).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    for language in (None, "python", "shell"):
        corpus = from_table(files, "path", "text", language)
        physical = plan(findings(scan_files(corpus))).split("== Physical Plan ==")[1]
        assert physical.count("regexp_replace") == 2
        assert "BroadcastHashJoin [check_key" in physical
        assert "NestedLoop" not in physical and "Cartesian" not in physical
        assert "Exchange hashpartitioning" not in physical and "Python" not in physical
        assert "ReadSchema: struct<path:string,text:string>" in physical


def test_from_table(spark):
    table = spark.createDataFrame([(1, "a/b.PY", "x"), (2, "Dockerfile", "é")], "id int, p string, t string")
    files = from_table(table, "p", "t").orderBy("path").collect()
    assert [tuple(f) for f in files] == [
        ("Dockerfile", "dockerfile", 2, "é"), ("a/b.PY", "python", 1, "x"),
    ]
    raw = table.withColumn("t", F.unhex(F.lit("61FF0D0A62")))
    assert from_table(raw, "p", "t").first()["text"] == "a\ufffd\nb"
    given = from_table(table, "id", "t", F.lit("go"), size=F.lit(5)).first()
    assert tuple(given) == ("1", "go", 5, "x")


def test_lost_findings_of_a_hot_file(spark):
    """One file with most of the matches: all come out, in order."""
    rows = [("hot.js", "javascript", "a == b\n" * 30_000)] + [
        (f"f{i}.js", "javascript", "c == d") for i in range(300)
    ]
    ordered = spark_rows(ordered_findings(scan_files(files_table(spark, rows))))
    assert len(ordered) == 30_300 and ordered == sorted(ordered)


def test_rules_only_travel_once(spark):
    table = builtin_rules().by_language(spark)
    assert table.count() == len(builtin_rules().languages()) + 2
    assert "LocalTableScan" in plan(table)
