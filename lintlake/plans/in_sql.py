"""The scan for those who write SQL alone: functions of a session, and a view of the rules.

`register` gives a session

* `lint_language(path)`: the language by file name, NULL if it is not a known one;
* `lint_lines(language, text)`: the lines rules match on, as an array of structs;
* `lint_counts(language, text)`: how often each rule matches, no line made;
* `lint_rules`: a view of the rules, to be joined on `rule_ord`.

    SELECT path, hit.*
    FROM (SELECT path, lint_lines(lint_language(path), text) AS hits FROM sources)
    LATERAL VIEW OUTER inline(hits) hit
    WHERE rule_ord IS NOT NULL

An inner view would do as well, but Spark infers size(hits) > 0 for it and searches twice. A
table function, joined laterally, would look better and be worse: Spark joins its rows back to
the distinct texts, which moves every text.

The rules are a constant of the plan, so a text is searched where it lies, by the same steps as
in `operators.scan`: strings a rule needs, then its regular expression, then the lines with
marks. Nothing is shuffled or joined. A null text gives no rows; a null or unknown language
gets the rules that hold for every language. The functions belong to the session; registering
again, with other rules or another least severity, replaces them.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from lintlake import schema
from lintlake.functions.severity import severity_rank
from lintlake.functions.text import FOLDS
from lintlake.rules import RuleSet, builtin_rules
from lintlake.rules.ruleset import ANY_LANGUAGE

_NEEDS = "array<array<string>>"
_CHECK = f"ord:int,rule_id:string,severity:string,pattern:string,until:string,needs:{_NEEDS}"
_GROUPS = f"array<struct<gate:array<string>,checks:array<struct<{_CHECK}>>>>"
_LINE = (
    "ARRAY<STRUCT<rule_ord: INT, rule_id: STRING, severity: STRING, line_number: INT, "
    "line_content: STRING, matches: INT> >"
)
_COUNT = "ARRAY<STRUCT<rule_ord: INT, rule_id: STRING, severity: STRING, matches: BIGINT> >"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _constant(value, layout: str) -> str:
    """A nested constant. Raw, so that it does not depend on how the session reads escapes."""
    text = json.dumps(value).replace("'", "\\u0027")
    return f"from_json(R'{text}', '{layout}')"


def _groups_by_language(rules: RuleSet, spark: SparkSession) -> dict:
    """What `RuleSet.by_language` holds, with what a finding says of its rule."""
    ids = rules.by_position(lambda rule: rule.rule_id)
    severities = rules.by_position(lambda rule: rule.severity)
    made = {}
    for key, groups in rules.by_language(spark).collect():  # one row per language
        made[key] = [
            {
                "gate": group["gate"],
                "checks": [
                    check.asDict() | {"rule_id": ids[check["ord"]], "severity": severities[check["ord"]]}
                    for check in group["checks"]
                ],
            }
            for group in groups
        ]
    return made


def _with_texts(body: str) -> str:
    """An expression over `s`, the text with unified newlines beside it in one case.

    Arrays of one, so that each of the two is made once and not wherever it is read.
    """
    unified = (
        "CASE WHEN contains(text, char(13)) THEN replace(replace(text, concat(char(13), char(10)), "
        "char(10)), char(13), char(10)) ELSE text END"
    )
    special = " OR ".join(f"contains(t, '{char}')" for char in FOLDS)
    plain = f"translate(t, '{''.join(FOLDS)}', '{''.join(FOLDS.values())}')"
    both = (
        f"named_struct('text', t, 'folded', CASE WHEN {special} THEN lower({plain}) ELSE lower(t) END)"
    )
    return f"transform(transform(array({unified}), t -> {both}), s -> {body})[0]"


def _marked(text: str) -> str:
    return f"regexp_replace({text}, c.pattern, concat(char(13), '$0'))"


def _searched(rules: RuleSet, spark: SparkSession) -> str:
    """The checks of the text's language whose strings occur, each with the marked text."""
    groups = _constant(_groups_by_language(rules, spark), f"map<string,{_GROUPS}>")
    known = ", ".join(map(_quoted, rules.languages())) or "NULL"
    key = f"CASE WHEN language IN ({known}) THEN language ELSE '{ANY_LANGUAGE}' END"
    occurs = "x -> contains(s.folded, x)"
    open_groups = (
        f"filter(element_at({groups}, {key}), g -> size(g.gate) = 0 OR exists(g.gate, {occurs}))"
    )
    checks = (
        f"filter(flatten(transform({open_groups}, g -> g.checks)), "
        f"c -> forall(c.needs, n -> exists(n, {occurs})))"
    )
    head = (
        "transform(array(regexp_extract(s.text, c.until, 0)), h -> CASE WHEN h <> '' THEN "
        f"concat({_marked('h')}, substring(s.text, length(h) + 1)) END)[0]"
    )
    marked = f"CASE WHEN c.until IS NULL THEN {_marked('s.text')} ELSE {head} END"
    return (
        f"filter(transform({checks}, c -> named_struct('ord', c.ord, 'rule_id', c.rule_id, "
        f"'severity', c.severity, 'marked', {marked})), m -> contains(m.marked, char(13)))"
    )


def _lines(searched: str) -> str:
    content = "replace(l, char(13), '')"
    line = (
        "named_struct('rule_ord', m.ord, 'rule_id', m.rule_id, 'severity', m.severity, "
        f"'line_number', i + 1, 'line_content', {content}, "
        f"'matches', octet_length(l) - octet_length({content}))"
    )
    lines = (
        "filter(transform(split(m.marked, char(10), -1), "
        f"(l, i) -> CASE WHEN contains(l, char(13)) THEN {line} END), l -> l IS NOT NULL)"
    )
    return _with_texts(f"flatten(transform({searched}, m -> {lines}))")


def _counts(searched: str) -> str:
    count = (
        "named_struct('rule_ord', m.ord, 'rule_id', m.rule_id, 'severity', m.severity, "
        "'matches', CAST(octet_length(m.marked) - octet_length(s.text) AS BIGINT))"
    )
    return _with_texts(f"transform({searched}, m -> {count})")


def _language() -> str:
    name = "substring_index(path, '/', -1)"
    # Leading dots start no suffix.
    bare = f"ltrim('.', {name})"
    suffix = (
        f"CASE WHEN contains({bare}, '.') THEN concat('.', lower(substring_index({bare}, '.', -1))) END"
    )
    makefiles = ", ".join(map(_quoted, schema.MAKEFILE_NAMES))
    known = " ".join(
        f"WHEN {suffix} IN ({', '.join(map(_quoted, suffixes))}) THEN '{language}'"
        for language, suffixes in schema.LANGUAGE_SUFFIXES.items()
        if suffixes
    )
    return (
        f"CASE WHEN {name} = 'Dockerfile' OR startswith({name}, 'Dockerfile.') THEN 'dockerfile' "
        f"WHEN {name} IN ({makefiles}) THEN 'shell' {known} END"
    )


def register(
    spark: SparkSession,
    rules: RuleSet | None = None,
    min_severity: str = "info",
    prefix: str = "lint_",
) -> None:
    """Register the functions and the view, named with the prefix, in a session."""
    active = (builtin_rules() if rules is None else rules).at_least(min_severity)
    searched = _searched(active, spark)

    def function(name: str, parameters: str, returns: str, body: str) -> None:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returns} RETURN {body}"
        )

    scanned = "language STRING, text STRING"
    nothing = "CASE WHEN text IS NULL THEN array() ELSE {} END"
    function("language", "path STRING", "STRING", _language())
    function("lines", scanned, _LINE, nothing.format(_lines(searched)))
    function("counts", scanned, _COUNT, nothing.format(_counts(searched)))
    table = active.table(spark).drop(*schema.RULE_INTERNALS).withColumnRenamed("ord", "rule_ord")
    table.withColumn("severity_rank", severity_rank(table["severity"])).createOrReplaceTempView(f"{prefix}rules")
