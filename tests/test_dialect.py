"""Patterns mean in Java what they mean in Python, and guards lose nothing."""

import random
import re
import warnings

import pytest

from lintlake import findings, scan_files
from lintlake.rules import RULES, Rule, RuleSet, builtin_rules
from lintlake.rules.dialect import to_java
from queryset import corpora
from tests.helpers import brute_force, files_table, spark_rows

# White space, word characters, line ends and case partners that engines disagree on.
ODD = [
    " ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ",
    " ", "　", "\r", "\r\n", "é", "ß", "ſ", "K", "ı", "İ", "²", "½", "٣",
    "́", "‍", "‿", "_", "中", "\U0001f600", "\U0001d7d8", "0", "a", "Z", "-", "'", '"',
    "(", ")", "=", ":", "+", ".", "/", "%", "==", "http://", "$", "{", "\\", "\x00",
]
PARTNERS = {"s": "ſ", "S": "ſ", "k": "K", "K": "K", "i": "ı", "I": "İ"}


def mangled(rng, text):
    """The text with characters swapped, dropped, doubled or replaced by odd ones."""
    out = []
    for char in text:
        roll = rng.random()
        if roll < 0.02:
            out.append(rng.choice(ODD))
        elif roll < 0.03:
            continue
        elif roll < 0.05 and char in PARTNERS:
            out.append(PARTNERS[char])
        elif roll < 0.10:
            out.append(char.swapcase())
        elif char == " " and roll < 0.3:
            out.append(rng.choice(ODD[:16]))
        else:
            out.append(char)
    return "".join(out)


def random_files(seed, count):
    rng = random.Random(seed)
    filled = lambda s: (
        s.replace("{n}", "7").replace("{p16}", "0" * 15 + "7").replace("{p36}", "a" * 36)
        .replace("{w}", "makers").replace("{N}", "Customer#7")
    )
    rows = []
    for number in range(count):
        language, _, own = corpora.SPECIFIC[rng.randrange(len(corpora.SPECIFIC))]
        pieces = [filled(rng.choice(rng.choice([own, corpora.COMMON]))) for _ in range(4)]
        text = rng.choice(["\n", " ", "\r\n", "", rng.choice(ODD)]).join(pieces)
        rows.append((f"f{number}", language, mangled(rng, text) if rng.random() < 0.8 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_match_like_python(spark, seed):
    rows = random_files(seed, 3000)
    found = spark_rows(findings(scan_files(files_table(spark, rows))))
    expected = brute_force(rows)
    assert len({row[5] for row in expected}) == len(RULES)
    assert sorted(found) == expected


def test_odd_characters_between_all_pairs(spark):
    """Every odd character next to the parts of patterns where classes and bounds matter."""
    shapes = [
        "password{}={}'abcdef'", "x{}eval{}(1)", "#{}TODO{}x", "from{}python{}\n", "0{}",
        "pip install{}django{}\nx", "a{}=={}b", "mysql://u{}r:p{}w@h", "runAsUser:{}0{}",
        "ADD{}h{}", "ARG{}MY{}TOKEN", "for x{}in y:{}\n z.get", "A{}IA" + "B" * 16,
        "{}CMD{}USER{}", "except{}:{}pass{}", "acl={}'public-read'{}", "T{}SERVICE", "AKIA{}" + "A" * 15,
    ]
    rows = []
    for shape in shapes:
        for first in ODD:
            for language in ("python", "yaml", "dockerfile", "javascript"):
                for second in ("", first, "\n", " "):
                    gaps = [first, second, first][: shape.count("{}")]
                    rows.append((f"f{len(rows)}", language, shape.format(*gaps)))
    found = spark_rows(findings(scan_files(files_table(spark, rows))))
    assert sorted(found) == brute_force(rows)


def test_guards_lose_nothing(spark):
    """The same findings without the needed strings, on the same texts."""
    rows = random_files(3, 1500)
    files = files_table(spark, rows)
    bare = RuleSet.of([rule._replace(needs=[], ends_with=None) for rule in RULES])
    guarded = spark_rows(findings(scan_files(files)))
    assert sorted(guarded) == sorted(spark_rows(findings(scan_files(files, bare), bare)))


CUSTOM = [
    r"(?P<quote>['\"])x(?P=quote)", r"a{,2}b", r"x{}y{z", r"[]a[]+", r"[^]b]c", r"[a&&b]+", r"\Aab",
    r"b\Z", r"\Bx\B", r"[\s\d]+x", r"[^\W\d]+", r"\D\S\W", r"^$", r"x*", r"a|^b$", r"[\b\v]", r"\0",
    r"\x41B\U00000043", r"[A-F]{2}", r"(?s:a.b)", r"a++b", r"(?<=\s)x", r"[\]\[]", r"#\#",
]


def test_custom_patterns_match_like_python(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rules = [
            Rule(f"C{i}", "t", "low", "quality", None, None, "high", p, [], "", "")
            for i, p in enumerate(CUSTOM)
        ]
        rng = random.Random(4)
        alphabet = list("xyzab'\"[]{}&# \n\t\\") + ["é", " ", "ABC", "EF", "\x00", "\x0b", "K", "{2}"]
        rows = [
            (f"f{n}", "python", "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))))
            for n in range(1500)
        ]
        made = RuleSet.of(rules, spark)
        assert made.rejected == []
        found = spark_rows(findings(scan_files(files_table(spark, rows), made), made))
        assert sorted(found) == brute_force(rows, rules)


def test_broken_patterns_are_rejected(spark):
    def rule(name, pattern):
        return Rule(name, "t", "low", "quality", None, None, "high", pattern, [], "", "")

    made = RuleSet.of(
        [rule("ok", "a+"), rule("open", "(a"), rule("python only", "(a)(?(1)b|c)")], spark
    )
    assert [r.rule_id for r in made] == ["ok"]
    assert [name for name, _, _ in made.rejected] == ["open", "python only"]
    assert made.rejected_table(spark).count() == 2


def test_all_patterns_compile(spark):
    for rule in builtin_rules():
        assert re.compile(rule.pattern)
        spark._jvm.java.util.regex.Pattern.compile(to_java(rule.pattern))
