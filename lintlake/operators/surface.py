"""Sets of public names, how they change, and which release is newest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import schema
from lintlake.functions.paths import qualify
from lintlake.rules import RuleSet


def of_rules(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The names a caller can observe of a rule set and the reports: (kind, name)."""
    suffixes = [s for known in schema.LANGUAGE_SUFFIXES.values() for s in known]
    groups = {
        "rule": [rule.rule_id for rule in rules],
        "category": {rule.category for rule in rules},
        "severity": schema.SEVERITIES,
        "language": schema.LANGUAGE_SUFFIXES,
        "ext": suffixes,
        "format": ["json", "markdown", "sarif", "text"],
    }
    rows = [(kind, name) for kind, names in groups.items() for name in names]
    return spark.createDataFrame(rows, "kind string, name string")


def union_names(*groups: DataFrame) -> DataFrame:
    """Distinct (kind, name) of several tables."""
    return reduce(DataFrame.unionByName, (g.select("kind", "name") for g in groups)).distinct()


def qualified(names: DataFrame) -> DataFrame:
    """Distinct `kind:name` strings in order."""
    return (
        names.select(qualify(F.col("kind"), F.col("name")).alias("qualified"))
        .distinct()
        .orderBy("qualified")
    )


def changes(published: DataFrame, candidate: DataFrame) -> DataFrame:
    """Names removed and names added between two surfaces.

    One grouping instead of two set differences: each side is read once.
    """
    both = published.select("kind", "name", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        candidate.select("kind", "name", F.lit(0).alias("old"), F.lit(1).alias("new"))
    )
    return (
        both.groupBy("kind", "name")
        .agg(F.max("old").alias("old"), F.max("new").alias("new"))
        .where("old <> new")
        .select("kind", "name", F.when(F.col("old") == 1, "removed").otherwise("added").alias("change"))
    )


def change_class(changed: DataFrame) -> DataFrame:
    """breaking if a name was removed, additive if only added, internal if neither."""
    counts = changed.agg(
        F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if(F.col("change") == "added").alias("added"),
    )
    return counts.withColumn(
        "change_class",
        F.when(F.col("removed") > 0, "breaking").when(F.col("added") > 0, "additive").otherwise(
            "internal"
        ),
    )


def newest_release(releases: DataFrame) -> DataFrame:
    """The tag of the highest version among (tag, version) rows.

    A tag that names a full version must agree with it, or it is passed over. Of tags with
    the same version, one that names it in full goes first, then the first by name.
    """
    claimed = F.ltrim("tag", F.lit("v"))
    parts = F.transform(F.split("version", r"\."), lambda part: part.try_cast("bigint"))
    claims_full = claimed.rlike(r"^\d+\.\d+\.\d+\z")
    trusted = releases.where(~claims_full | (claimed == F.col("version"))).select(
        "tag", "version", parts.alias("parts"), claims_full.alias("full")
    )
    newest = F.struct(F.col("parts"), F.col("full"))
    # The name breaks ties downwards, so it is settled per version before the maximum.
    return (
        trusted.groupBy("version", "parts", "full")
        .agg(F.min("tag").alias("tag"))
        .agg(F.max_by(F.struct("tag", "version"), newest).alias("newest"))
        .where("newest IS NOT NULL")
        .select("newest.tag", "newest.version")
    )
