r"""How far a rule's search can read behind the place where it starts, from its pattern.

A pattern is a sequence of parts that read a bounded number of characters and of unbounded
repeats. What an unbounded repeat reads are characters that occur somewhere in it, so it stops
at the first other one. Taking every part in turn at its longest, and all ways of an alternative
one after the other, gives a place behind which the search has read nothing, whatever it tried
on the way: each step only moves a later place further. A text that has this place is *closed*
for the rule: what follows it cannot change what a search finds that starts before the text.
"""

from __future__ import annotations

import re
from re import _constants as code
from re import _parser as parser

from lintlake.rules.dialect import FLAGS, to_java

#: Closes nothing: for patterns that look back, name a group again or ask for the text's ends.
NEVER = FLAGS + r"(?!)"

#: A group with a run in it that may be repeated more often counts as unbounded.
MOST_TURNS = 16

_REPEATS = (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT)
_CATEGORIES = {
    code.CATEGORY_SPACE: r"\s", code.CATEGORY_NOT_SPACE: r"\S",
    code.CATEGORY_WORD: r"\w", code.CATEGORY_NOT_WORD: r"\W",
    code.CATEGORY_DIGIT: r"\d", code.CATEGORY_NOT_DIGIT: r"\D",
}


class _Unbounded(Exception):
    """The pattern reads in a way that its parts do not tell."""


def closing(pattern: str) -> str:
    """A Java pattern that finds, from the start of a text, what closes it for a rule."""
    try:
        parts = _read(parser.parse(pattern, re.IGNORECASE | re.MULTILINE))
    except _Unbounded:
        return NEVER
    # One more character: the one at which the last part stops.
    return FLAGS + r"\A" + "".join(part if isinstance(part, str) else f"(?s:.{{{part}}})" for part in [*parts, 1])


def _read(items) -> list[int | str]:
    """The parts in turn: a number of characters, or a pattern that takes a whole run."""
    parts: list[int | str] = []
    for kind, value in items:
        if kind in _REPEATS:
            least, most, inner = value
            if most == code.MAXREPEAT:
                parts += [f"[{''.join(sorted(_classes(inner)))}]*+"]
                continue
            once = _read(inner)
            if any(isinstance(part, str) for part in once) and most > MOST_TURNS:
                raise _Unbounded
            parts += once * most if any(isinstance(part, str) for part in once) else [most * sum(once)]
        elif kind is code.BRANCH:
            for way in value[1]:
                parts += _read(way)
        elif kind in (code.SUBPATTERN, code.ATOMIC_GROUP):
            parts += _read(_inner(kind, value))
        elif kind in (code.ASSERT, code.ASSERT_NOT) and value[0] > 0:
            parts += _read(value[1])
        elif kind is code.AT and value not in (code.AT_BEGINNING_STRING, code.AT_END_STRING):
            parts.append(1)  # looks at the next character
        elif kind in (code.LITERAL, code.NOT_LITERAL, code.ANY, code.IN, code.CATEGORY):
            parts.append(1)
        else:
            raise _Unbounded
    return _summed(parts)


def _summed(parts: list[int | str]) -> list[int | str]:
    made: list[int | str] = []
    for part in parts:
        if made and isinstance(part, int) and isinstance(made[-1], int):
            made[-1] += part
        elif part != 0:
            made.append(part)
    return made


def _inner(kind, value):
    if kind is code.ATOMIC_GROUP:
        return value
    _, added, removed, inner = value
    if added or removed:
        raise _Unbounded
    return inner


def _classes(items) -> set[str]:
    """Every class of characters that occurs in a part, in Java's notation."""
    made = set()
    for kind, value in items:
        if kind in _REPEATS:
            made |= _classes(value[2])
        elif kind is code.BRANCH:
            made |= set().union(*(_classes(way) for way in value[1]))
        elif kind in (code.SUBPATTERN, code.ATOMIC_GROUP):
            made |= _classes(_inner(kind, value))
        elif kind is code.ANY:
            made.add(r"[^\n]")
        elif kind in (code.LITERAL, code.NOT_LITERAL, code.IN):
            made.add(_class(kind, value))
    return made


def _class(kind, value) -> str:
    if kind is not code.IN:
        value = [(code.LITERAL, value)] if kind is code.LITERAL else [(code.NEGATE, None), (code.LITERAL, value)]
    members = "".join(_member(*item) for item in value)
    return to_java(f"[{members}]").removeprefix(FLAGS)


def _member(kind, value) -> str:
    if kind is code.NEGATE:
        return "^"
    if kind is code.LITERAL:
        return rf"\U{value:08x}"
    if kind is code.RANGE:
        return rf"\U{value[0]:08x}-\U{value[1]:08x}"
    if kind is code.CATEGORY:
        return _CATEGORIES[value]
    raise _Unbounded
