"""Severities, grades and SARIF levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake import schema
from lintlake.functions.text import strip


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.element_at(F.create_map(*pairs), key)


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for info."""
    return _lookup({name: rank for rank, name in enumerate(schema.SEVERITIES)}, severity)


def deduction(severity: Column) -> Column:
    return _lookup(schema.DEDUCTIONS, severity)


def is_blocking(severity: Column) -> Column:
    return severity.isin("critical", "high")


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("critical", "high"), "error")
        .when(severity == "medium", "warning")
        .otherwise("note")
    )


def score_to_grade(score: Column) -> Column:
    # The lowest score of each grade.
    steps = [(95, "A+"), (90, "A"), (80, "B+"), (70, "B"), (60, "C"), (50, "D")]
    grade = F
    for lowest, name in steps:
        grade = grade.when(score >= lowest, name)
    return grade.otherwise("F")


def check_severity(name: str) -> str:
    """A severity parameter, trimmed and lower-cased; raises if unknown."""
    cleaned = name.lower().strip()
    if cleaned not in schema.SEVERITIES:
        known = ", ".join(reversed(schema.SEVERITIES))
        raise ValueError(f"Invalid severity: {cleaned}. Choose from: {known}")
    return cleaned


def parse_severity(name: Column) -> Column:
    """A severity column, trimmed and lower-cased; the query fails on an unknown one."""
    cleaned = F.lower(strip(name))
    return F.when(cleaned.isin(schema.SEVERITIES), cleaned).when(
        cleaned.isNotNull(),
        F.raise_error(F.concat(F.lit("Invalid severity: "), cleaned)).cast("string"),
    )
