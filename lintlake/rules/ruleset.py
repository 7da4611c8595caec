"""Rule sets: validated, filtered, and handed to Spark as small tables."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lintlake import schema
from lintlake.functions.severity import check_severity
from lintlake.rules.catalog import RULES, Rule
from lintlake.rules.dialect import to_java
from lintlake.rules.heads import for_folded, headed

# Rules are configuration and get broadcast. A set beyond this many bytes, in the form that is
# sent to every executor, is refused rather than cut; RuleSet takes another bound.
MAX_BYTES = 64 * 1024 * 1024

# Keys of files whose language no rule names, and of files that could not be read.
ANY_LANGUAGE = "*"
NO_TEXT = "-"

_CHECKS = (
    "check_key string, groups array<struct<gate:array<string>, "
    "checks:array<struct<ord:int, pattern:string, until:string, needs:array<array<string>>>>>>"
)


class RuleSet:
    """An ordered set of rules. `rejected` lists (rule_id, pattern, reason) left out."""

    def __init__(
        self, rules: Iterable[tuple[int, Rule, str]], rejected=(), max_bytes: int = MAX_BYTES
    ):
        self._rules = list(rules)  # (position, rule, Java pattern)
        self.rejected = list(rejected)
        self.max_bytes = max_bytes

    def __len__(self) -> int:
        return len(self._rules)

    def __iter__(self):
        return (rule for _, rule, _ in self._rules)

    @classmethod
    def of(
        cls, rules: Iterable[Rule], spark: SparkSession | None = None, max_bytes: int = MAX_BYTES
    ) -> RuleSet:
        """Keep the rules whose pattern compiles, here and (given a session) in Java."""
        accepted, rejected = [], []
        for position, rule in enumerate(rules):
            try:
                pattern = headed(rule.pattern)
                tail = to_java(rule.ends_with or "")
                if spark is not None:
                    for java in (pattern, tail):
                        spark._jvm.java.util.regex.Pattern.compile(java)
            except Exception as error:  # re.error, or PatternSyntaxException by way of py4j
                reason = str(getattr(error, "java_exception", None) or error)
                rejected.append((rule.rule_id, rule.pattern, reason.splitlines()[0]))
            else:
                accepted.append((position, rule, pattern))
        return cls(accepted, rejected, max_bytes)

    @classmethod
    def from_table(cls, rules: DataFrame, max_bytes: int = MAX_BYTES) -> RuleSet:
        """The caller's own rules, from any table with the rule columns.

        Order is `ord` where present, else rule_id and pattern. Severity, category and
        confidence are read without regard to case and outer blanks. What the built-in rules
        say about strings a match holds is not taken from a caller, so nothing they say can
        lose a finding. A rule without an id, pattern, severity or category is left out and
        listed in `rejected`. `max_bytes` bounds the set, see MAX_BYTES.
        """
        columns = [name for name in Rule._fields if name in rules.columns]
        columns = [name for name in columns if name not in ("needs", "ends_with")]
        missing = {"rule_id", "pattern", "severity", "category"} - set(columns)
        if missing:
            raise ValueError(f"rule table lacks {', '.join(sorted(missing))}")
        size = sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns)
        if (rules.agg(F.sum(size)).first()[0] or 0) > max_bytes:
            raise ValueError(f"rule table has more than {max_bytes} bytes")
        order = ["ord"] if "ord" in rules.columns else []
        rows = rules.orderBy(*order, "rule_id", "pattern").select(columns).collect()
        blank = Rule("", "", "", "", None, None, "high", "", [], "", "")
        made, rejected = [], []
        for row in rows:
            given = {k: v for k, v in row.asDict().items() if v is not None}
            lacking = [k for k in ("rule_id", "pattern", "severity", "category") if k not in given]
            if lacking:
                rejected.append((row["rule_id"], row["pattern"], f"no {', '.join(lacking)}"))
                continue
            given["languages"] = given.get("languages") or None
            given["cwe_id"] = given.get("cwe_id") or None
            given["severity"] = check_severity(given["severity"])
            for name in ("category", "confidence"):
                if name in given:
                    given[name] = given[name].strip().lower()
            made.append(blank._replace(**given))
        found = cls.of(made, rules.sparkSession, max_bytes)
        found.rejected = rejected + found.rejected
        return found

    def at_least(self, severity: str) -> RuleSet:
        """Rules of this severity or a higher one, keeping their positions."""
        lowest = schema.SEVERITIES.index(check_severity(severity))
        return self._where(lambda rule: schema.SEVERITIES.index(rule.severity) <= lowest)

    def only(self, rule_ids: Iterable[str] = (), categories: Iterable[str] = ()) -> RuleSet:
        wanted_ids, wanted_categories = set(rule_ids), set(categories)
        return self._where(
            lambda rule: rule.rule_id in wanted_ids or rule.category in wanted_categories
        )

    def _where(self, keep) -> RuleSet:
        kept = (entry for entry in self._rules if keep(entry[1]))
        return RuleSet(kept, self.rejected, self.max_bytes)

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as a DataFrame."""
        rows = [
            (position, r.rule_id, r.title, r.pattern, r.severity, r.category, r.description,
             r.suggestion, r.cwe_id, r.languages, r.confidence, r.needs, r.ends_with)
            for position, r, _ in self._rules
        ]
        return _local_table(spark, rows, schema.RULES)

    def rejected_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rejected, "rule_id string, pattern string, reason string")

    def by_position(self, value) -> list:
        """A value for every position up to the last, None where the set has no rule."""
        made = {position: value(rule) for position, rule, _ in self._rules}
        return [made.get(position) for position in range(max(made, default=-1) + 1)]

    def languages(self) -> list[str]:
        return sorted({language for rule in self for language in rule.languages or ()})

    def by_language(self, spark: SparkSession) -> DataFrame:
        """One row per language with all the checks that apply to it.

        Rules that need the same string first form a group with that string as its gate.
        The row `*` serves every language that no rule names.
        """
        rows = [(NO_TEXT, [])]
        for language in [*self.languages(), ANY_LANGUAGE]:
            groups = {}
            for (languages, gate), checks in self.by_gate().items():
                if languages is None or language in languages:
                    plain = [{k: v for k, v in check.items() if k != "folded"} for check in checks]
                    groups.setdefault(gate, []).extend(plain)
            made = [{"gate": list(gate), "checks": checks} for gate, checks in groups.items()]
            rows.append((language, made))
        return _local_table(spark, rows, _CHECKS, self.max_bytes)

    def by_gate(self) -> dict[tuple, list[dict]]:
        """The checks by (languages or None for all, gate).

        `folded` has pattern and until for a text of `fold_case`, if matches can be counted in it.
        """
        groups = {}
        for position, rule, pattern in self._rules:
            languages = None if rule.languages is None else tuple(sorted(rule.languages))
            gate, *needs = [entry.split("|") for entry in rule.needs] or [[]]
            needs = _quickest_first(needs)
            tail = None if rule.ends_with is None else r"\A(?s:.*)" + rule.ends_with
            until = None if tail is None else to_java(tail)
            folded = (for_folded(rule.pattern), None if tail is None else for_folded(tail))
            if folded[0] is None or (folded[1] is None) != (tail is None):
                folded = None
            check = {"ord": position, "pattern": pattern, "until": until, "needs": needs, "folded": folded}
            groups.setdefault((languages, tuple(gate)), []).append(check)
        return groups

    def check_key(self, language: Column, text: Column) -> Column:
        """The key in `by_language` for a file."""
        # Always a column, never a constant, so that the join on it is a hash join.
        return (
            F.when(text.isNull(), NO_TEXT)
            .when(language.isin(self.languages()), language)
            .otherwise(ANY_LANGUAGE)
        )


def _quickest_first(needs: list[list[str]]) -> list[list[str]]:
    """The needed strings so that few searches tell that one is missing: entries of few strings
    first, and before those of several what all of these hold, if that is not too short."""
    made = []
    for entry in sorted(needs, key=len):
        least = min(entry, key=len)
        parts = {least[a:b] for a in range(len(least)) for b in range(a + 3, len(least) + 1)}
        held = [part for part in parts if all(part in other for other in entry)]
        if len(entry) > 1 and held:
            made.append([max(sorted(held), key=len)])
        made.append(entry)
    return made


def _local_table(
    spark: SparkSession, rows: list[tuple], layout: str, max_bytes: int | None = None
) -> DataFrame:
    """Rows that travel in the plan, so that Spark knows their size without a job."""
    fields = to_arrow_schema(StructType.fromDDL(layout))
    columns = list(zip(*rows)) or [()] * len(fields)
    made = pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)
    if max_bytes is not None and made.nbytes > max_bytes:
        raise ValueError(f"the rules take {made.nbytes} bytes, more than {max_bytes}")
    return spark.createDataFrame(made)


def builtin_rules() -> RuleSet:
    return RuleSet.of(RULES)


def duplicate_ids(rules: DataFrame) -> DataFrame:
    """Rule ids used more than once."""
    return rules.groupBy("rule_id").agg(F.count("*").alias("uses")).where("uses > 1")


def categories_in_use(rules: DataFrame) -> DataFrame:
    return rules.select("category").distinct().orderBy("category")
