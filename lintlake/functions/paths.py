"""File paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake import schema


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """From the last dot of the name on; leading dots do not start a suffix."""
    name = F.ltrim(base_name(path), F.lit("."))
    return F.when(
        F.contains(name, F.lit(".")),
        F.concat(F.lit("."), F.substring_index(name, ".", -1)),
    ).otherwise("")


def detect_language(path: Column) -> Column:
    """Language by file name, NULL if it is not a known one."""
    name = base_name(path)
    pairs = [
        F.lit(part)
        for language, suffixes in schema.LANGUAGE_SUFFIXES.items()
        for known in suffixes
        for part in (known, language)
    ]
    return (
        F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "dockerfile")
        .when(name.isin(schema.MAKEFILE_NAMES), "shell")
        .otherwise(F.element_at(F.create_map(*pairs), F.lower(suffix(path))))
    )


def is_skipped(rel_path: Column) -> Column:
    """Whether a directory on the way from the root to the file is never entered."""
    parts = F.split(rel_path, "/", -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(dirs, lambda d: d.isin(schema.SKIPPED_DIRS) | d.startswith("."))


def rel_path(path: Column, root: str) -> Column:
    """The path below a root directory, `.` for the root itself."""
    base = root.rstrip("/")
    return (
        F.when(path == (base or "/"), ".")
        .when(path.startswith(base + "/"), path.substr(F.lit(len(base) + 2), F.length(path)))
        .otherwise(path)
    )


def qualify(kind: Column, name: Column) -> Column:
    """A public name as `kind:name`."""
    return F.concat_ws(":", kind, name)
