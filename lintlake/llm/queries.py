"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import (
    centroid_clustering,
    chat,
    decontaminate,
    jaccard_join,
    language_id,
    lattice_lm,
    line_dedup,
    mixing,
    pii,
    quality_crf,
    quality_rules,
    url_filter,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query("op1_quality_rules", quality_rules.SQL)
def op1(spark, sf):
    judged = quality_rules.judge(read(spark, sf, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host_rate",
    )


@query("op4_url_filters", url_filter.SQL)
def op4(spark, sf):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    judged = url_filter.judge(read(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_mixing", mixing.sql())
def op9(spark, sf):
    return mixing.taken(read(spark, sf, "documents"))


@query("op2_pii", pii.SQL)
def op2(spark, sf):
    return pii.digest(read(spark, sf, "documents"))


@query("op7_decontamination", decontaminate.sql())
def op7(spark, sf):
    found = decontaminate.report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op8_jaccard_join", jaccard_join.sql())
def op8(spark, sf):
    joined = jaccard_join.join(read(spark, sf, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


@query("op5_line_dedup")
def op5(spark, sf):
    found = line_dedup.repeated_lines(read(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed", "copies_of")


@query("op3_chat_formatting", chat.SQL)
def op3(spark, sf):
    tricky = spark.createDataFrame(chat.TRICKY, "conv_id bigint, turn bigint, role string, text string")
    logged = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.event_log(logged.unionByName(tricky))
    return chat.digest(chat.format_chats(log, seq="seq", kind="kind"))


@query("op10_language_id")
def op10(spark, sf):
    docs = read(spark, sf, "documents")
    return language_id.predict(docs, language_id.learn(docs))


@query("op6_quality_classifier")
def op6(spark, sf):
    docs = read(spark, sf, "documents")
    return quality_crf.score(docs, quality_crf.learn(docs, read(spark, sf, "labels")))


@query("op12_centroid_clustering", centroid_clustering.sql())
def op12(spark, sf):
    return centroid_clustering.cluster(read(spark, sf, "embeddings"))


@query("op13_embedding_whitening")
def op13(spark, sf):
    return whitening.whiten(read(spark, sf, "embeddings"))


@query("op11_lm_scoring")
def op11(spark, sf):
    docs = read(spark, sf, "documents")
    return lattice_lm.score(docs, lattice_lm.learn(docs))
