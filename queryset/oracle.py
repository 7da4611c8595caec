"""SQL for the checks. It finds matches another way than the scan does: by splitting each
text on the pattern and counting newlines in the pieces before each match."""

from __future__ import annotations

from lintlake import schema
from lintlake.rules import RULES
from queryset.corpora import quote

# White space and word characters as the patterns mean them; RE2's own are ASCII only.
_SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WORD = r"\p{L}\p{N}_"

# RE2 has no look-ahead: such rules are matched with what follows, and matches that the
# look-ahead refuses are taken out again. The loops over lines need no rewriting here.
_REWRITTEN = {
    "INJ006": (r"\.innerHTML\s*==?", "==$"),
    "CFG003": (
        r"https?://[a-zA-Z0-9.-]+\.[a-z]{2,}",
        r"(?i)^https?://(localhost|127\.0\.0\.1|0\.0\.0\.0|example\.com|example\.org)",
    ),
    "DOC001": (r"^.*(?:CMD|ENTRYPOINT).*(?:\n|\z)", r"(?i)USER\s"),
    "DOC003": (r"\bADD\s+(?:https?://)?", r"(?i)^ADD\shttps?://$"),
    "PRF001": (
        r"(?:async\s+def\s+.*\n(?:.*\n)*?.*(?:open\(|os\.path|shutil\.))"
        r"|(?:await.*(?:open\(|os\.path))",
        None,
    ),
    "PRF003": (r"for\s+.*:\s*\n(?:.*\n)*?\s*re\.(?:search|match|findall|sub)\s*\(", None),
}


def to_re2(pattern: str) -> str:
    # Inside these two classes the members are added without brackets of their own.
    held = {r"""[^@\s'"]""": f"""[^@{_SPACE}'"]""", r"[\w-]": f"[{_WORD}-]"}
    for number, written in enumerate(held):
        pattern = pattern.replace(written, f"\x00{number}")
    pattern = pattern.replace(r"\s", f"[{_SPACE}]").replace(r"\w", f"[{_WORD}]")
    pattern = pattern.replace(r"\d", r"\p{Nd}")
    for number, meant in enumerate(held.values()):
        pattern = pattern.replace(f"\x00{number}", meant)
    return "(?im)" + pattern


def rules_sql(rules) -> str:
    """The rules' own columns as a table expression, from (position, rule) pairs."""
    rows = [
        f"({position}, {quote(rule.rule_id)}, {quote(rule.title)}, {quote(rule.severity)}, "
        f"{schema.SEVERITIES.index(rule.severity)}, {quote(rule.category)}, "
        f"{quote(rule.description)}, {quote(rule.suggestion)}, {quote(rule.cwe_id)}, "
        f"{quote(rule.confidence)})"
        for position, rule in rules
    ]
    return (
        "(SELECT * FROM (VALUES " + ",\n".join(rows) + ") AS t(rule_ord, rule_id, title, severity, "
        "severity_rank, category, description, suggestion, cwe_id, confidence))"
    )


def _matched_sql(position: int, rule) -> str:
    """The files one rule matches in, each with its text taken apart at the matches."""
    pattern, reject = _REWRITTEN.get(rule.rule_id, (rule.pattern, None))
    pattern = quote(to_re2(pattern))
    kept = "true"
    if reject is not None:
        kept = f"NOT regexp_matches(m, {quote(reject.replace(r'\s', f'[{_SPACE}]'))})"
    applies = "true"
    if rule.languages is not None:
        applies = "language IN (" + ", ".join(quote(x) for x in rule.languages) + ")"
    return (
        f"SELECT path, text, {position} AS rule_ord, string_split_regex(text, {pattern}) AS pieces, "
        f"regexp_extract_all(text, {pattern}) AS found, "
        f"list_transform(found, lambda m: {kept}) AS kept "
        f"FROM files WHERE {applies} AND regexp_matches(text, {pattern})"
    )


def skipped_sql(path: str) -> str:
    dirs = f"list_slice(string_split({path}, '/'), 1, len(string_split({path}, '/')) - 1)"
    names = "[" + ", ".join(quote(d) for d in schema.SKIPPED_DIRS) + "]"
    return (
        f"len(list_filter({dirs}, lambda d: list_contains({names}, d) OR starts_with(d, '.'))) > 0"
    )


def reason_sql() -> str:
    return (
        f"CASE WHEN {skipped_sql('path')} THEN 'directory' WHEN language IS NULL THEN 'language' "
        f"WHEN size IS NULL THEN 'unreadable' WHEN size > {schema.MAX_FILE_SIZE} THEN 'size' END"
    )


def scannable_sql(files: str) -> str:
    return f"(SELECT path, language, size, text FROM {files} WHERE ({reason_sql()}) IS NULL)"


UNIFIED = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def findings_ctes(files: str, keep=lambda rule: True, catalog=RULES) -> str:
    """`files`, `rules` and `findings` as common table expressions."""
    rules = [(position, rule) for position, rule in enumerate(catalog) if keep(rule)]
    matched = "\nUNION ALL ".join(_matched_sql(position, rule) for position, rule in rules)
    return f"""files AS MATERIALIZED (
  SELECT path, language, size, {UNIFIED} AS text FROM {files}
),
rules AS (SELECT * FROM {rules_sql(rules)}),
matched AS ({matched}),
placed AS (
  SELECT *, unnest(generate_series(1, len(found))) AS nth FROM matched
),
lined AS (
  SELECT path, text, rule_ord, nth, kept[nth] AS is_kept,
         1 + length(regexp_replace(array_to_string(pieces[1:nth], '') ||
             coalesce(array_to_string(found[1:nth - 1], ''), ''), '[^\\n]', '', 'g')) AS line_number
  FROM placed
),
findings AS MATERIALIZED (
  SELECT rule_id, title, description, severity, category, path AS file_path, line_number,
         string_split(text, chr(10))[line_number] AS line_content, suggestion, cwe_id, confidence,
         severity_rank, rule_ord,
         row_number() OVER (PARTITION BY path, rule_ord, line_number ORDER BY nth) AS match_ord
  FROM lined JOIN rules USING (rule_ord) WHERE is_kept
)"""


def line_count_sql(text: str = "text") -> str:
    return f"length({text}) - length(replace({text}, chr(10), '')) + 1"
