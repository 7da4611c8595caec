"""From raw documents to a training mix, in five stages.

Each stage takes what the one before has kept, written as Parquet and read again. All but the
last return the columns of `documents`; the last returns the words that the mix takes of each.

A stage called by itself leaves the tables that its result reads in the folder for intermediate
tables. `run` removes those of all stages but the last, whose result it returns; it holds no
state, so several runs, also at once, do not touch each other's tables.

Null texts have no words, are rejected by the first stage and so reach no other. Rows equal in
all columns are documents of their own until the third stage, which keeps one of each group of
copies; ties there go to the least id, nulls last. Null ids and sources are kept as such. Other
columns pass through, whatever their names. An empty table gives an empty mix. As line
deduplication comes before near duplicates, near copies meet the third stage as what is left of
them beside their shared lines, and most that were similar are not any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_rules
from lintlake.sources.store import keep, recorded, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat, exactly or nearly, one stays; documents left without a word go."""
    left = line_dedup.deduplicated(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share three quarters of their shingles one stays."""
    return jaccard_join.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document."""
    return mixing.taken(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing", mix),
]

# Line deduplication by MinHash is beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, run_stage in STAGES[:-1]:
        with recorded() as left:
            made = run_stage(spark, docs, sf_dir)
        kept = keep(made)
        release(docs, *left)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
