"""Quality rules with verdicts per host.

Every document is measured in one pass of SQL expressions. Failures are counted per host, the
rates are shrunk with a beta prior fitted to all hosts, and the verdict on a host is joined
back to its documents: in a host that mostly fails, a document has to meet the strict limits,
elsewhere the lenient ones. A clean document is kept wherever it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.columns import NO_SPACE, SPACE, bind, boxed, text_of, total, words_of
from lintlake.sources.store import keep

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
# Soft limits: symbols by words, and repeated lines by lines with words.
LENIENT = (0.5, 0.5)
STRICT = (0.2, 0.2)
BAD_HOST = 0.5
# How many documents the prior may count for.
STRENGTH = (1.0, 1000.0)


def _covered(positions: Column, width: int) -> Column:
    """Places covered by windows of a width that start at sorted, distinct positions."""
    return bind(
        positions,
        lambda starts: total(
            F.transform(
                starts,
                lambda p, i: F.least(
                    F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))
                ).cast("bigint"),
            )
        ),
    )


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window that is found twice or more in the array.

    Windows are compared by a 64-bit hash. Sorting brings equal ones side by side, so the
    work is that of a sort, however often one window is found.
    """

    def doubles(windows: Column) -> Column:
        def twice(window: Column, i: Column) -> Column:
            after = F.get(windows, i + 1)["key"] == window["key"]
            before = F.get(windows, i - 1)["key"] == window["key"]
            return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

        return F.array_sort(F.transform(F.filter(windows, twice), lambda w: w["at"]))

    def repeated(words: Column) -> Column:
        keyed = F.transform(
            F.sequence(F.lit(0), F.size(words) - width),
            lambda i: F.struct(
                F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("key"), i.alias("at")
            ),
        )
        found = _covered(bind(F.sort_array(keyed), doubles), width)
        return F.when(F.size(words) >= width, found).otherwise(F.lit(0).cast("bigint"))

    return bind(words, repeated)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    A null text has no words. `docs` has no columns of these names.
    """
    value = text_of(text)
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(NO_SPACE))
    few = F.col("n_words") < MIN_WORDS
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    return (
        docs.withColumns({"_words": words_of(value), "_lines": lines})
        .withColumns(
            {
                "n_words": F.size("_words").cast("bigint"),
                "word_chars": F.length(F.regexp_replace(value, SPACE, "")).cast("bigint"),
                "n_symbols": F.length(F.regexp_replace(value, r"[^#*$%&|<>]+", "")).cast("bigint"),
                "n_lines": F.size("_lines").cast("bigint"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
                "n_repeat_words": repeated_words(F.col("_words")),
            }
        )
        .drop("_words", "_lines")
        .withColumn("base_failed", few | repeated)
    )


def breaks(limits: tuple[float, float]) -> Column:
    """Whether a measured document breaks a soft rule at these limits."""
    symbols, lines = limits
    return (F.col("n_symbols") > symbols * F.col("n_words")) | (
        F.col("n_dup_lines") > lines * F.col("n_lines")
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by a beta prior.

    The prior is fitted to the rates of all hosts by their mean and variance (method of
    moments), so a host of few documents moves towards the mean of all. `measured` has the
    column `host`; a null host is a host of its own.
    """
    failed = F.col("base_failed") | breaks(STRICT)
    hosts = keep(
        measured.groupBy("host").agg(
            F.count("*").alias("n"), F.sum(failed.cast("bigint")).alias("fails")
        )
    )
    rate = F.col("fails") / F.col("n")
    mean, variance = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    mean = mean or 0.0
    strength = mean * (1 - mean) / variance - 1 if variance else STRENGTH[1]
    strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
    shrunk = (F.col("fails") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("host_rate", F.round(shrunk, 6))


def add_verdict(measured: DataFrame, rates: DataFrame) -> DataFrame:
    """Join the hosts' rates to measured documents and add `kept`."""
    rates = rates.select(F.col("host").alias("_host"), "host_rate")
    limits = F.when(F.col("host_rate") > BAD_HOST, breaks(STRICT)).otherwise(breaks(LENIENT))
    return (
        measured.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left")
        .drop("_host")
        .withColumn("kept", ~(F.col("base_failed") | limits))
    )


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per document: key, host, its measures, host_rate and kept.

    Equal rows give equal rows, an empty table gives an empty one. The measures are stored
    without the text, so texts are read once.
    """
    chosen = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    measured = keep(measure(chosen).drop("text"))
    return add_verdict(measured, host_rates(measured)).withColumnRenamed("key", key)


def kept_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns as they are.

    Rows are stored with their measures, to be filtered when all hosts are known.
    """
    measured = keep(measure(boxed(docs, host=host, text=text)).drop("text"))
    return add_verdict(measured, host_rates(measured)).where("kept").select("row.*")


# The same in SQL, for a table `documents`.
_SPACE_SQL = r"'[ \t-\r]+'".replace("\\t", "\\x09").replace("\\r", "\\x0D")
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t,
        list_filter(regexp_split_to_array(t, {_SPACE_SQL}), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, [words[i], words[i + 1], words[i + 2]] AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, gram HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n
            FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT r, doc_id, host, len(words)::BIGINT AS n_words,
        length(regexp_replace(t, {_SPACE_SQL}, '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeats USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
        n_symbols > {LENIENT[0]}::DOUBLE * n_words OR n_dup_lines > {LENIENT[1]}::DOUBLE * n_lines AS lenient,
        n_symbols > {STRICT[0]}::DOUBLE * n_words OR n_dup_lines > {STRICT[1]}::DOUBLE * n_lines AS strict FROM m),
h AS (SELECT host, count(*) AS n, sum((base_failed OR strict)::BIGINT)::BIGINT AS fails FROM f GROUP BY host),
p AS (SELECT avg(fails / n) AS mean, var_pop(fails / n) AS v FROM h),
s AS (SELECT mean, least(greatest(CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 ELSE {STRENGTH[1]} END,
        {STRENGTH[0]}), {STRENGTH[1]}) AS strength FROM p),
rates AS (SELECT host, round((fails + mean * strength) / (n + strength), 6) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR CASE WHEN host_rate > {BAD_HOST} THEN strict ELSE lenient END) AS kept,
       host_rate
FROM f JOIN rates ON f.host IS NOT DISTINCT FROM rates.host
"""
