"""Patterns that Java searches for faster, with the same matches.

Java tries a pattern at every place of a text, and each of its alternatives there. A look at the
next one or two characters, where the pattern says what they can be, passes over most places.
Where only the number of matches is asked for, the folded text can be searched: its letters are
compared as they are, and Java skips along the text for a pattern that begins with a word.
"""

from __future__ import annotations

import re
import string
from re import _constants as code
from re import _parser as parser

from lintlake.rules.dialect import FLAGS, to_java

#: Characters that are looked at, and members of a class beyond which there is no look.
LENGTH, MEMBERS = 2, 24

#: The flags of a pattern whose letters are compared as they are.
_EXACT = "(?d)"


#: What a pattern's plain letters are told apart by: escapes and names of groups stay.
_TOKEN = re.compile(r"\\.|\(\?P[<=]\w+[>)]|[A-Z]", re.DOTALL)
#: Escapes that name a character by its number or name, and groups that are named again.
_NUMBERED = re.compile(r"(?<!\\)(?:\\\\)*(?:\\[xuUN0-9]|\(\?P=|\(\?\()")


def headed(pattern: str) -> str:
    """The pattern for Java, after a look at the characters that it can begin with."""
    return _with_head(pattern, to_java(pattern))


def for_folded(pattern: str) -> str | None:
    """The pattern for Java with as many matches in a text of `fold_case` as the pattern itself
    has in the text, None if that is not certain.

    Folding takes every character to one character, and those that equal an ASCII letter to that
    letter, so a pattern of ASCII characters does not tell the texts apart.
    """
    if not pattern.isascii() or _NUMBERED.search(pattern):
        return None
    if not _whole_ranges(parser.parse(pattern, re.IGNORECASE | re.MULTILINE)):
        return None
    lowered = _TOKEN.sub(lambda found: found[0] if len(found[0]) > 1 else found[0].lower(), pattern)
    java = _with_head(lowered, to_java(lowered))
    return java.replace(FLAGS, _EXACT, 1)


def _whole_ranges(items) -> bool:
    """Whether every range of a class takes letters of one case only, or none."""
    for kind, value in items:
        if kind is code.IN:
            for member, ends in value:
                if member is code.RANGE:
                    span = {chr(c) for c in range(ends[0], min(ends[1], 127) + 1)}
                    upper, lower = (span & set(case) for case in (string.ascii_uppercase, string.ascii_lowercase))
                    if ends[1] > 127 or (upper or lower) and (span != upper and span != lower):
                        return False
        elif kind in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
            if not _whole_ranges(value[2]):
                return False
        elif kind is code.BRANCH:
            if not all(_whole_ranges(way) for way in value[1]):
                return False
        elif kind is code.SUBPATTERN:
            if not _whole_ranges(value[3]):
                return False
        elif kind in (code.ASSERT, code.ASSERT_NOT):
            if not _whole_ranges(value[1]):
                return False
        elif kind is code.ATOMIC_GROUP:
            if not _whole_ranges(value):
                return False
    return True


def _with_head(pattern: str, java: str) -> str:
    items = list(parser.parse(pattern, re.IGNORECASE | re.MULTILINE))
    # A literal is as quickly compared as looked at.
    heads, _ = _heads(items) if pattern[:1] in ("(", "[", "\\") else ([], True)
    # In the pattern's own flags, so that a class holds what its characters equal.
    classes = ["[" + "".join(rf"\x{{{char:x}}}" for char in sorted(head)) + "]" for head in heads[:LENGTH]]
    return java.replace(FLAGS, f"{FLAGS}(?={''.join(classes)})", 1) if classes else java


def _heads(items) -> tuple[list[set[int]], bool]:
    """What the first characters can be, one by one, as far as every way through the items has
    that many, and whether that is all that the items match."""
    heads: list[set[int]] = []
    for kind, value in items:
        if kind is code.LITERAL:
            made, whole = [{value}], True
        elif kind is code.IN:
            members = _members(value)
            made, whole = ([members], True) if members else ([], False)
        elif kind is code.BRANCH:
            ways = [_heads(way) for way in value[1]]
            made = [set().union(*heads_) for heads_ in zip(*(way for way, _ in ways))]
            whole = all(done and len(way) == len(made) for way, done in ways)
        elif kind is code.SUBPATTERN and not (value[1] or value[2]):
            made, whole = _heads(value[3])
        elif kind is code.MAX_REPEAT and value[0] > 0:
            made, whole = _heads(value[2])[0], False
        elif kind in (code.AT, code.ASSERT, code.ASSERT_NOT):
            made, whole = [], True
        else:
            made, whole = [], False
        heads += made
        if not whole:
            return heads, False
    return heads, True


def _members(items) -> set[int] | None:
    """The characters of a class, if they are few and named one by one."""
    if any(kind is not code.LITERAL for kind, _ in items) or len(items) > MEMBERS:
        return None
    return {value for _, value in items}
