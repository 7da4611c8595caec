"""Turn a rule's pattern from Python's `re` dialect into Java's, which Spark runs.

Rules are matched ignoring case with `^` and `$` at line bounds. The two dialects spell the
same constructs but disagree on what some of them cover, so those are written out:

* `\\s`, `\\w`, `\\d`, `\\b` and their opposites cover Unicode in Python;
* `^` also matches after a final newline, `$` only at a newline (never at CR or U+2028);
* ignoring case, `[A-Z]` also takes what `[a-z]` takes (the Kelvin sign, dotted I);
* in a class, `[` and `&&` are plain characters;
* looking behind, Python sees a character beyond the basic plane whole;
* `{` that opens no repeat count is a plain character, and `{,n}` means `{0,n}`.

One difference stays: where a pattern prefers an empty match to a longer one at the same
place (`|a`), Python reports both and Java only the first. No rule matches the empty text.
"""

from __future__ import annotations

import re

# Ignore case (also beyond ASCII); only \n ends a line.
FLAGS = "(?iud)"

# Java looks behind by whole characters only if a character beyond the basic plane stands
# later in the pattern; this one matches nothing.
_WHOLE_CHARACTERS = "(?:\U0001d7d8){0}"

# What Python's classes hold, in Java's notation.
_CLASSES = {
    "s": r"\p{IsWhite_Space}\x1c-\x1f",
    "w": r"\p{L}\p{N}_",
    "d": r"\p{Nd}",
}
_WORD = f"[{_CLASSES['w']}]"
_EDGES = {
    "b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
    "Z": r"\z",
    "v": r"\x0b",
}
_TOKEN = re.compile(
    r"\\U(?P<wide>[0-9a-fA-F]{8})"
    r"|\\0(?P<octal>[0-7]{0,2})"
    r"|\\(?P<escape>.)"
    r"|\(\?P<(?P<named>\w+)>"
    r"|\(\?P=(?P<back>\w+)\)"
    r"|\{(?P<repeat>\d*,?\d*)\}"
    r"|(?P<range>[A-Z]-[A-Z])"
    r"|(?P<other>.)",
    re.DOTALL,
)


def to_java(pattern: str) -> str:
    """The same pattern for Java, flags included. Raises `re.error` if it is not valid."""
    compiled = re.compile(pattern, re.IGNORECASE | re.MULTILINE)
    out = [FLAGS]
    in_class = False
    class_start = -1  # where a class's first member would stand
    pos = 0
    while pos < len(pattern):
        token = _TOKEN.match(pattern, pos)
        kind, text = token.lastgroup, token.group()
        if in_class and kind in ("named", "back", "repeat") or not in_class and kind == "range":
            kind, text = "other", pattern[pos]
        value = token.group(kind) if kind != "other" else text
        if kind == "wide":
            out.append(r"\x{%x}" % int(value, 16))
        elif kind == "octal":
            out.append(r"\x%02x" % int(value or "0", 8))
        elif kind == "escape":
            out.append(_escape(value, in_class))
        elif kind == "named":
            out.append("(")
        elif kind == "back":
            out.append(rf"(?:\{compiled.groupindex[value]})")
        elif kind == "repeat":
            out.append(_repeat(value))
        elif kind == "range":
            out.append(value + value.lower())
        elif in_class:
            if text == "]" and pos != class_start:
                in_class = False
                out.append(text)
            else:
                out.append("\\" + text if text in "[]&" else text)
        elif text == "[":
            in_class = True
            negated = pattern[pos + 1 : pos + 2] == "^"
            out.append("[^" if negated else "[")
            class_start = pos + 2 if negated else pos + 1
            text = pattern[pos:class_start]
        else:
            out.append({"^": r"(?<![^\n])", "$": r"(?![^\n])", "{": r"\{"}.get(text, text))
        pos += len(text)
    java = "".join(out)
    return java + _WHOLE_CHARACTERS if "(?<=" in java or "(?<!" in java else java


def _escape(char: str, in_class: bool) -> str:
    if char.lower() in _CLASSES:
        members = _CLASSES[char.lower()]
        if char.isupper():
            return f"[^{members}]"
        return members if in_class else f"[{members}]"
    if in_class:
        return {"b": r"\x08", "v": r"\x0b"}.get(char, "\\" + char)
    return _EDGES.get(char, "\\" + char)


def _repeat(counts: str) -> str:
    if counts in ("", ","):
        return r"\{" + counts + "}" if not counts else "*"
    return "{" + ("0" if counts.startswith(",") else "") + counts + "}"
