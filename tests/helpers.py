"""Brute force in plain Python, to hold the Spark results against."""

import re

from lintlake import schema
from lintlake.rules import RULES

FILES = "path string, language string, size bigint, text string"


def files_table(spark, rows):
    """rows: (path, language, text)"""
    sized = [(p, lang, None if t is None else len(t.encode()), t) for p, lang, t in rows]
    return spark.createDataFrame(sized, FILES)


def brute_force(rows, rules=RULES, min_severity="info"):
    """(rank, path, line, rule position, n-th match on that line, rule id, line text), sorted."""
    lowest = schema.SEVERITIES.index(min_severity)
    out = []
    for path, language, text in rows:
        if text is None:
            continue
        text = re.sub("\r\n?", "\n", text)
        lines = text.split("\n")
        for position, rule in enumerate(rules):
            rank = schema.SEVERITIES.index(rule.severity)
            if rank > lowest or (rule.languages and language not in rule.languages):
                continue
            seen = {}
            for match in re.finditer(rule.pattern, text, re.IGNORECASE | re.MULTILINE):
                number = text.count("\n", 0, match.start()) + 1
                seen[number] = seen.get(number, 0) + 1
                out.append(
                    (rank, path, number, position, seen[number], rule.rule_id, lines[number - 1])
                )
    return sorted(out)


def spark_rows(findings):
    columns = [*schema.ORDER_COLUMNS, "rule_id", "line_content"]
    return [tuple(row) for row in findings.select(columns).collect()]
