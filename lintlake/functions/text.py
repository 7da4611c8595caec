"""Text as the scan sees it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# The non-ASCII characters that equal an ASCII letter when case is ignored
# (long s, dotless i, dotted I, Kelvin sign).
FOLDS = {"ſ": "s", "ı": "i", "İ": "i", "K": "k"}


def unify_newlines(text: Column) -> Column:
    r"""`\r\n` and `\r` become `\n`; text without `\r` passes untouched."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\r")), plain).otherwise(text)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 text, U+FFFD for what is not, newlines unified."""
    return unify_newlines(F.make_valid_utf8(content.cast("string")))


def newline_count(text: Column) -> Column:
    without = F.replace(text, F.lit("\n"), F.lit(""))
    return (F.octet_length(text) - F.octet_length(without)).cast("bigint")


def line_count(text: Column) -> Column:
    """Newlines + 1: an empty text has one line, a final newline starts another."""
    return newline_count(text) + F.lit(1).cast("bigint")


def line_at(text: Column, number: Column) -> Column:
    """The text of one line, counted from 1."""
    return F.element_at(F.split(text, "\n", -1), number)


def fold_case(text: Column) -> Column:
    """Lower case, with every character that equals an ASCII letter turned into it."""
    special = F.lit(False)
    for char in FOLDS:
        special = special | F.contains(text, F.lit(char))
    unified = F.translate(text, "".join(FOLDS), "".join(FOLDS.values()))
    return F.when(special, F.lower(unified)).otherwise(F.lower(text))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def snippet(line: Column) -> Column:
    """A line's first 80 characters, white space at the ends removed."""
    return F.substring(strip(line), 1, 80)
