r"""Matches of a pattern and the lines they start on, as column expressions.

A carriage return is put before each match. Text whose newlines are unified holds no other
one, so splitting the marked text into lines gives line number, line text and number of
matches from one pass of the regular expression, also for matches that span lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.rules.dialect import to_java

_MARK = "\r"


def marked(text: Column, java_pattern: Column) -> Column:
    """The text with a mark before every match."""
    return F.regexp_replace(text, java_pattern, F.lit(_MARK + "$0"))


def marked_up_to(text: Column, java_pattern: Column, until: Column) -> Column:
    """The same, where nothing after the match of `until`, which starts the text, can match:
    the rest is put back without being searched. NULL where there is no such match."""

    def searched(head: Column) -> Column:
        rest = text.substr(F.length(head) + 1, F.length(text))
        return F.when(head != "", F.concat(marked(head, java_pattern), rest))

    # An array of one, so that the head, a greedy run over the text, is searched for once.
    head = F.call_function("regexp_extract", text, until, F.lit(0))
    return F.transform(F.array(head), searched)[0]


def has_marks(marked_text: Column) -> Column:
    return F.contains(marked_text, F.lit(_MARK))


def marked_lines(marked_text: Column, **extra: Column) -> Column:
    """The lines with marks: struct of `extra`, line_number, line_content and matches."""
    named = [value.alias(name) for name, value in extra.items()]

    def line_with_marks(line: Column, index: Column) -> Column:
        content = F.replace(line, F.lit(_MARK), F.lit(""))
        return F.when(
            has_marks(line),
            F.struct(
                *named,
                (index + 1).alias("line_number"),
                content.alias("line_content"),
                (F.octet_length(line) - F.octet_length(content)).alias("matches"),
            ),
        )

    lines = F.transform(F.split(marked_text, "\n", -1), line_with_marks)
    return F.filter(lines, lambda line: line.isNotNull())


def match_lines(text: Column, pattern: str) -> Column:
    """The lines of a text, newlines unified, on which matches of a pattern start."""
    return marked_lines(marked(text, F.lit(to_java(pattern))))


def match_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(to_java(pattern)))
