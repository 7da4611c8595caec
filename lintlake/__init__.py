"""Source-scan analytics on Spark: files joined with detection rules, as DataFrames."""

__version__ = "0.1.0"

from lintlake.rules import Rule, RuleSet, builtin_rules
from lintlake.operators.scan import count_files, findings, ordered_findings, scan, scan_files
from lintlake.sources.tables import from_table
from lintlake.sources.tree import read_file, read_tree

__all__ = [
    "Rule",
    "RuleSet",
    "builtin_rules",
    "count_files",
    "findings",
    "from_table",
    "ordered_findings",
    "read_file",
    "read_tree",
    "scan",
    "scan_files",
]
