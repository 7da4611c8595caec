"""Table layouts and fixed vocabularies shared by the package."""

from __future__ import annotations

FILES = "path string, language string, size bigint, text string"

RULES = (
    "ord int, rule_id string, title string, pattern string, severity string, "
    "category string, description string, suggestion string, cwe_id string, "
    "languages array<string>, confidence string, needs array<string>, ends_with string"
)
# Columns that say how a rule is run, not what it reports.
RULE_INTERNALS = ["pattern", "languages", "needs", "ends_with"]

# One row per scanned file; `hits` holds one entry per line a rule matched on, with the
# number of matches that start there.
SCANNED = (
    "path string, language string, lines bigint, hits array<struct<ord:int, "
    "line_number:int, line_content:string, matches:int>>"
)

FINDING_COLUMNS = [
    "rule_id",
    "title",
    "description",
    "severity",
    "category",
    "file_path",
    "line_number",
    "line_content",
    "suggestion",
    "cwe_id",
    "confidence",
]
ORDER_COLUMNS = ["severity_rank", "file_path", "line_number", "rule_ord", "match_ord"]

# Severities from most to least severe, and what one finding of each costs
# in the score.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
DEDUCTIONS = {"critical": 20, "high": 10, "medium": 5, "low": 2, "info": 0}

# Finding categories.
CATEGORIES = [
    "security",
    "secret",
    "injection",
    "quality",
    "performance",
    "deprecation",
    "configuration",
    "supply-chain",
]

# File suffixes by language.
LANGUAGE_SUFFIXES = {
    "python": [".py", ".pyw"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "ruby": [".rb"],
    "php": [".php"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc", ".cxx"],
    "csharp": [".cs"],
    "shell": [".sh", ".bash", ".zsh"],
    "yaml": [".yml", ".yaml"],
    "dockerfile": [],
    "terraform": [".tf"],
    "sql": [".sql"],
}
MAKEFILE_NAMES = ["Makefile", "makefile", "GNUmakefile"]

# Directory names that are never entered ("*.egg-info" is compared as it
# stands), and the largest file a tree scan reads.
SKIPPED_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".tox",
    ".pytest_cache", ".mypy_cache", "venv", ".venv", "env", ".env",
    "vendor", "dist", "build", ".next", ".nuxt", "target",
    "coverage", ".coverage", "htmlcov", ".eggs", "*.egg-info",
]
MAX_FILE_SIZE = 1_000_000

# Path parts left out of a file-hash manifest.
MANIFEST_EXCLUDED = [".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache"]
