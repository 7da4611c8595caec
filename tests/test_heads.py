"""The counting scan's patterns: constants of the plan, faster to search for, with equal counts."""

import random
import re

from pyspark.sql import functions as F

from lintlake import RuleSet, count_files, scan_files
from lintlake.functions.text import fold_case
from lintlake.operators import scan as scan_module
from lintlake.rules import RULES, builtin_rules
from lintlake.rules.dialect import FLAGS, to_java
from lintlake.rules.heads import for_folded, headed
from queryset import corpora
from tests.helpers import files_table

ODD = ["K", "ſ", "ı", "İ", "\xe9", "\xc9", "Σ", "ς", "\xdf", " ", "\x85", "\n",
       "\U0001d7d8", "\x1c", "\xa0", "0", "_"]


def odd_texts(n, seed=3):
    """Snippets in any case with odd characters thrown in, also in place of the letters they equal."""
    draw = random.Random(seed)
    snippets = corpora.COMMON + [s for _, _, own in corpora.SPECIFIC for s in own]
    equal = {"k": "\u212a", "s": "\u017f", "i": draw.choice("\u0131\u0130")}
    made = []
    for _ in range(n):
        text = "\n".join(draw.sample(snippets, 4)).replace("{p36}", "0a" * 18).replace("{n}", "7")
        chars = [draw.choice((c, c, c, c.upper(), c.lower(), equal.get(c.lower(), c))) for c in text]
        for _ in range(6):
            chars.insert(draw.randrange(len(chars)), draw.choice(ODD))
        made.append("".join(chars))
    return made


def test_faster_patterns_find_as_much(spark):
    texts = spark.createDataFrame([(t,) for t in odd_texts(300)], "text string").withColumn("folded", fold_case(F.col("text")))
    columns = []
    for rule in RULES:
        plain = F.regexp_count("text", F.lit(to_java(rule.pattern)))
        columns.append(F.sum(F.abs(plain - F.regexp_count("text", F.lit(headed(rule.pattern))))))
        folded = for_folded(rule.pattern)
        assert folded is not None, rule.rule_id
        columns.append(F.sum(F.abs(plain - F.regexp_count("folded", F.lit(folded)))))
        columns.append(F.sum(plain))
    found = texts.agg(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    assert not any(found[0::3]) and not any(found[1::3])
    assert sum(n > 0 for n in found[2::3]) > 60


def test_patterns_that_folding_could_change_are_left():
    for pattern in ("[A-z]x", "[ -Z]x", "é", r"\x41b", r"(?P<a>x)(?P=a)", r"(a)\1", "[a-é]"):
        assert for_folded(pattern) is None, pattern
    assert for_folded(r"\S\W\D[A-Z]X").removeprefix("(?d)") == to_java(r"\S\W\D[a-z]x").removeprefix(FLAGS)
    assert headed("(?:ab|cd)e").startswith(FLAGS + r"(?=[\x{61}\x{63}][\x{62}\x{64}])")
    for pattern in ("(?:a?|b)c", "(?:|a)b", "(?:a|.)b", "[^a]b", "(?:ab)*c"):
        assert headed(pattern) == to_java(pattern), pattern
    assert re.search(r"\(\?=", headed("(?:a|bc)d"))


def test_counting_joins_no_rules_and_agrees_with_the_scan(spark, monkeypatch):
    suffixes = [language for language, _, _ in corpora.SPECIFIC]
    rows = [(f"f{k}", suffixes[k % len(suffixes)], text) for k, text in enumerate(odd_texts(200, 5))]
    files = files_table(spark, [*rows, ("none", "python", None), ("empty", "go", "")])
    rules = builtin_rules()
    own = RuleSet.of([*rules, RULES[0]._replace(rule_id="X1", pattern="É|[ -Z]{3}", needs=[])])
    for chosen in (rules, own, own.only(rule_ids=["X1"]), rules.only()):
        counted = count_files(files, chosen)
        assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
        hits = "aggregate(filter(hits, h -> h.ord = o), 0L, (n, h) -> n + h.matches)"
        summed = f"transform(array_sort(array_distinct(hits.ord)), o -> struct(o, {hits}))"
        wanted = scan_files(files, chosen).selectExpr("path", "lines", f"{summed} AS counts").collect()
        got = counted.selectExpr("path", "lines", "array_sort(counts) AS counts").collect()
        as_set = lambda rows_: {(r[0], r[1], tuple(tuple(c) for c in r[2])) for r in rows_}
        assert as_set(got) == as_set(wanted)
        monkeypatch.setattr(scan_module, "WRITTEN_OUT", -1)
        joined = count_files(files, chosen).selectExpr("path", "lines", "array_sort(counts) AS counts").collect()
        monkeypatch.undo()
        assert as_set(joined) == as_set(wanted)


def test_rendering_deals_rows_by_their_number(spark, tmp_path):
    table = spark.range(45).selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "'BUILDING' AS c_mktsegment")
    table.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    before, corpora.ROWS_A_TASK = corpora.ROWS_A_TASK, 1
    try:
        assert corpora.rendered(spark, str(tmp_path)).rdd.getNumPartitions() >= 45
    finally:
        corpora.ROWS_A_TASK = before
