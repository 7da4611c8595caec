from lintlake.rules.catalog import RULES, Rule
from lintlake.rules.ruleset import RuleSet, builtin_rules

__all__ = ["RULES", "Rule", "RuleSet", "builtin_rules"]
