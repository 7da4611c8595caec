"""Files in segments of lines give the findings of the whole text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lintlake import Rule, RuleSet, findings, read_tree, scan_files
from lintlake.operators import segmented
from lintlake.operators.scan import describe, each_match
from lintlake.rules import RULES, builtin_rules
from lintlake.rules.closing import NEVER, closing
from lintlake.sources import segments
from lintlake.sources.tree import list_tree
from tests.test_scan import MIXED

PLACE = ["file_path", "rule_id", "line_number", "line_content", "match_ord"]


def compare(spark, root, size, behind, rules=None):
    """Findings, and languages and lines, of the tree in segments and in whole files."""
    listing = list_tree(spark, root)
    hits, files = segmented.large_hits(listing, root, rules, segment=size, behind=behind)
    got = describe(each_match(hits), rules or builtin_rules()).select(PLACE)
    whole = scan_files(read_tree(spark, root, max_size=1 << 40), rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, findings(whole, rules).select(PLACE).collect()))
    counted = sorted(map(tuple, whole.select("path", "language", "lines").collect()))
    assert sorted(map(tuple, files.collect())) == counted
    return got


def write(tmp_path, texts):
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    return str(tmp_path)


PIECES = [
    b"password = 'hunter22'", b"api_key = 'abc", b"defghijkl'", b"eval(x)", b"# TODO: x", b"token =", b"", b"x" * 300, b"\xff\xc3 caf\xc3\xa9",
    b"for x in y:", b"  db.query(x)", b"async def f():", b"  open(x)", b"catch (e) {", b"}", b"'", b"-----BEGIN RSA PRIVATE KEY-----",
]


@pytest.mark.parametrize(("size", "behind"), [(40, 30), (200, 100), (1000, 5000)])
def test_segments_of_random_files(spark, tmp_path, size, behind):
    rng = random.Random(size)
    texts = {
        f"f{k}.{rng.choice(['py', 'js'])}": rng.choice([b"\n", b"\r\n", b"\r"]).join(rng.choices(PIECES, k=rng.randrange(60)))
        for k in range(12)
    }
    texts |= {"empty.py": b"", "line.js": b"eval(x)", "breaks.py": b"\n" * 100, "mixed.py": b"a\r\n\rb\n\r\neval(x)\r"}
    compare(spark, write(tmp_path, texts), size, behind)


def test_caller_rules_in_segments(spark, tmp_path):
    """Patterns that look back, span any number of lines, or read far ahead."""
    patterns = [r"(?<=b\n)a+", r"begin[\s\S]*?end", r"(a)\1", r"x(?!.*y)", r"\Aa", r"(?:ab\n){2,3}c", r"q{1,40}", r"^a$"]
    rules = RuleSet.of([Rule(f"R{k}", "", "low", "quality", None, None, "high", p, [], "", "") for k, p in enumerate(patterns)], spark)
    rng = random.Random(8)
    lines = [b"a", b"ab", b"b", b"aa", b"begin", b"end", b"x", b"xy", b"c", b"qqq", b""]
    texts = {f"f{k}.py": b"\n".join(rng.choices(lines, k=80)) for k in range(6)}
    compare(spark, write(tmp_path, texts), 30, 20, rules)


def test_one_large_file_over_many_tasks(spark, tmp_path):
    """Ten megabytes in twenty segments; most rules never see the whole text."""
    rng = random.Random(5)
    lines = [line for _, _, text in MIXED if text for line in text.split("\n")]
    lines += ["plain words in a line of some length, as most lines are"] * 400 + [p.decode("latin1") for p in PIECES if b"async" not in p]
    text = "\n".join(rng.choices(lines, k=200_000)).encode()
    root = write(tmp_path, {"big.js": text})
    got = compare(spark, root, 1 << 19, 1 << 14)
    assert got.count() > 5_000
    parts = segments.read_segments(list_tree(spark, root), root, 1 << 19, 1 << 14)
    assert parts.count() >= len(text) >> 19
    assert parts.select(F.spark_partition_id()).distinct().count() > 8
    found = segmented.scan_segments(parts, builtin_rules())
    again = {r["o"] for r in found.select(F.explode("again").alias("o")).distinct().collect()}
    assert len(again) <= 8  # of more than sixty that apply


def test_segments_are_whole_lines(spark, tmp_path):
    text = "".join("é" * n + random.Random(n).choice(["\n", "\r\n", "\r"]) for n in range(90)).encode()
    root = write(tmp_path, {"a.py": text})
    for size in (1, 7, 64, 10_000):
        rows = segments.read_segments(list_tree(spark, root), root, size, 50).orderBy("segment").collect()
        assert "".join(r["own"] for r in rows) == re.sub("\r\n?", "\n", text.decode())
        assert all(r["own"].endswith("\n") for r in rows) and rows[-1]["is_last"]
        assert all("\ufffd" not in r["behind"] for r in rows)


def test_closing_is_far_enough(spark):
    """What follows a closed text never changes what a search finds that starts before it."""
    rng = random.Random(11)
    alphabet = list("'\" =:()\n\t.x{}") + ["password", "eval", "for x in y:", "http://a.bc", "TODO", "except", "innerHTML =", "f\"{", ".execute("]
    cases = [
        (k, closing(rule.pattern), *("".join(rng.choices(alphabet, k=n)) for n in (6, 60, 8)))
        for k, rule in enumerate(RULES) for _ in range(60)
    ]
    table = spark.createDataFrame(cases, "rule int, pattern string, own string, behind string, more string")
    closed = table.where(F.rlike("behind", F.col("pattern"))).collect()
    assert len(closed) > 1000
    for row in closed:
        search, own = re.compile(RULES[row["rule"]].pattern, re.I | re.M), row["own"] + "\n"
        found, other = (
            [m.span() for m in search.finditer(text) if m.start() < len(own)]
            for text in (own + row["behind"], own + row["behind"] + row["more"])
        )
        assert found == other, row


def test_patterns_that_never_close(spark):
    for pattern in (r"(?<=a)b", r"(a)\1", r"\Aa", r"a\Z"):
        assert closing(pattern) == NEVER
    rows = spark.createDataFrame([(closing(r"a[^'\s]+(?:b|c\d{2})*d?"), "xx'1 "), (closing(r"[\s\S]*b"), "xx'1 ")], "p string, t string")
    assert [r[0] for r in rows.select(F.rlike("t", F.col("p"))).collect()] == [True, False]
    for rule in RULES:
        spark._jvm.java.util.regex.Pattern.compile(closing(rule.pattern))
