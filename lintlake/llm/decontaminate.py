"""Benchmark decontamination by winnowing.

Of every WINDOW consecutive words the k-gram with the least hash is chosen (of equal ones the
last), and each chosen place is kept once, as a fingerprint. What is chosen in a window depends
on its words alone, so texts that share WINDOW words or more share a fingerprint there, wherever
their other words differ. Documents and items are joined on the fingerprint alone; a hit is
extended to both sides over the hashes of the words beside it, as far as a window through it
reaches, and counts if a whole window is shared. Longer spans are covered by the hits of their
other windows. A bit table of the items' fingerprints, of fixed size, keeps the documents'
other fingerprints from being shuffled; as it fills, more are, and none is missed.

An item of fewer words is one window; it is its own fingerprint, of all n-grams of a document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm import bits, tokens
from lintlake.llm.columns import boxed, in_small_batches
from lintlake.sources.store import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
GRAM = 5

#: Words beside a k-gram that a window through it may hold, on either side.
REACH = WINDOW - GRAM
_NEAR = 2 * REACH + GRAM

_WINDOWS = "item string, n int, print bigint, near array<bigint>"
_FOUND = "doc_id bigint, tag bigint, n_words bigint, windows array<struct<at:int,n:int,print:bigint,near:array<bigint>>>"


def chosen(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the k-grams that winnowing chooses in the texts, and all k-grams' hashes."""
    parts = tokens.grams(hashes, GRAM)
    count = max(len(hashes) - WINDOW + 1, 0)
    least, place = parts[:count].copy(), np.arange(count)
    for k in range(1, REACH + 1):
        later = parts[k : k + count]
        better = later <= least
        least[better] = later[better]
        place[better] = np.flatnonzero(better) + k
    return np.unique(place[tokens.starts(bounds, WINDOW, count)]), parts


def _beside(hashes: np.ndarray, bounds: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """Hashes of the words around each k-gram, `none` where its text has no word."""
    text = np.searchsorted(bounds, at, "right") - 1
    places = at[:, None] + np.arange(-REACH, REACH + GRAM)
    inside = (places >= bounds[text][:, None]) & (places < bounds[text + 1][:, None])
    return np.where(inside, hashes[np.clip(places, 0, max(len(hashes) - 1, 0))], np.uint64(none))


def _as_lists(rows: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(rows).reshape(-1).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * _NEAR, values)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = tokens.letters_and_digits()
    for batch in tokens.small_batches(batches, "text"):
        hashes, bounds = tokens.words(*tokens.text_bytes(batch.column("text")), codes)
        ids = np.array(batch.column("item").to_pylist(), dtype=object)
        counts = np.diff(bounds)
        at, parts = chosen(hashes, bounds)
        item = np.searchsorted(bounds, at, "right") - 1
        rows = [(ids[item], np.full(len(at), WINDOW), parts[at], _beside(hashes, bounds, at, 1))]
        for n in range(1, WINDOW):
            short = np.flatnonzero(counts == n)
            if short.size:
                own = tokens.grams(hashes, n)[bounds[short]]
                rows.append((ids[short], np.full(len(short), n), own, np.zeros((len(short), _NEAR), np.uint64)))
        made = [np.concatenate(column) for column in zip(*rows)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(made[0], pa.string()),
                pa.array(made[1].astype(np.int32)),
                pa.array(made[2].astype(np.uint64).view(np.int64)),
                _as_lists(made[3].astype(np.uint64)),
            ],
            names=["item", "n", "print", "near"],
        )


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, print, near), one row per fingerprint of an item; the id as a string."""
    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(_item_windows, _WINDOWS)


def _document_windows(table: np.ndarray, lengths: list[int]):
    """Fingerprints of documents that may be an item's; a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = tokens.letters_and_digits()
        for batch in tokens.small_batches(batches, "text"):
            hashes, bounds = tokens.words(*tokens.text_bytes(batch.column("text")), codes)
            found = []
            for n in lengths:
                if n == WINDOW:
                    at, prints = chosen(hashes, bounds)
                    at = at[bits.passes(table, prints[at])]
                    near = _beside(hashes, bounds, at, 0)
                else:
                    prints = tokens.grams(hashes, n)
                    at = np.flatnonzero(bits.passes(table, prints))
                    at = at[tokens.starts(bounds, n, len(prints))[at]]
                    near = np.zeros((len(at), _NEAR), np.uint64)
                found.append((at, np.full(len(at), n, np.int32), prints[at], near))
            found = found or [(np.empty(0, np.int64),) * 3 + (np.empty((0, _NEAR), np.uint64),)]
            at, n, prints, near = (np.concatenate(column) for column in zip(*found))
            order = np.argsort(at, kind="stable")
            at = at[order]
            doc = np.searchsorted(bounds, at, "right") - 1
            lists = np.searchsorted(doc, np.arange(len(bounds)))
            entries = pa.StructArray.from_arrays(
                [
                    pa.array((at - bounds[doc]).astype(np.int32)),
                    pa.array(n[order].astype(np.int32)),
                    pa.array(prints[order].astype(np.uint64).view(np.int64)),
                    _as_lists(near[order]),
                ],
                names=["at", "n", "print", "near"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tag"),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), entries),
                ],
                names=["doc_id", "tag", "n_words", "windows"],
            )

    return run


def _extended(near: Column, other: Column) -> tuple[Column, Column]:
    """How many words before and behind a shared k-gram are shared too, without a gap."""
    same = F.zip_with(near, other, lambda a, b: a == b)

    def run(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, equal: F.when(equal, n + 1).otherwise(0))

    return run(F.slice(same, 1, REACH)), run(F.reverse(F.slice(same, REACH + GRAM + 1, REACH)))


def _covered(spans: Column) -> Column:
    """Words in the union of spans (at, n)."""
    begin = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("bigint").alias("hit"))

    def add(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], span["at"] + span["n"])
        new = end - F.greatest(state["end"], span["at"])
        return F.struct(end.alias("end"), (state["hit"] + F.greatest(new, F.lit(0))).alias("hit"))

    return F.aggregate(F.sort_array(spans), begin, add, lambda state: state["hit"])


@in_small_batches
def report(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, tag, n_words, n_hit, n_items, items, contaminated.

    A word is hit that lies inside an occurrence of an item's window; `items` are the ids, as
    strings, of items with occurring windows. `tag` hashes the text, so that documents of one
    id are told apart; equal rows give equal rows. A null text has no words, an item without
    words no window.
    """
    windows = keep(
        item_windows(items).distinct().withColumn("place", F.xxhash64("print", "n", "near"))
    )
    lengths = [row[0] for row in windows.select("n").distinct().orderBy("n").collect()]
    wanted = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("tag"),
        F.col(text).alias("text"),
    )
    found = keep(wanted.mapInArrow(_document_windows(bits.table(windows.select("print")), lengths), _FOUND))
    prints = found.where(F.size("windows") > 0).select("doc_id", "tag", F.inline("windows"))
    places = windows.select("place", "print", F.col("n").alias("of"), F.col("near").alias("other")).distinct()
    before, behind = _extended(F.col("near"), F.col("other"))
    met = prints.join(places, "print").where(F.col("n") == F.col("of"))
    long = F.col("n") == WINDOW
    span = F.struct(
        F.when(long, F.col("at") - F.col("before")).otherwise(F.col("at")).alias("at"),
        F.when(long, F.col("before") + GRAM + F.col("behind")).otherwise(F.col("n")).alias("n"),
    )
    hits = keep(
        met.select("doc_id", "tag", "place", "at", "n", before.alias("before"), behind.alias("behind"))
        .where(~long | (F.col("before") + GRAM + F.col("behind") >= WINDOW))
        .select("doc_id", "tag", "place", span.alias("span"))
    )
    spans = hits.groupBy("doc_id", "tag").agg(_covered(F.collect_set("span")).alias("n_hit"))
    named = (
        hits.select("doc_id", "tag", "place")
        .distinct()
        .join(windows.select("item", "place").distinct(), "place")
        .groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )

    def same(left: str, right: str, tag: str) -> Column:
        return F.col(left).eqNullSafe(F.col(right)) & (F.col("tag") == F.col(tag))

    hit = spans.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_mark"), "n_hit")
    none = F.array().cast("array<string>")
    return (
        found.select("doc_id", "tag", "n_words")
        .join(hit, same("doc_id", "_doc", "_mark"), "left")
        .join(named, same("doc_id", "_id", "_tag"), "left")
        .select(
            "doc_id",
            "tag",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
            F.coalesce("items", none).alias("items"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def clean_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without a hit word, with all their columns as they are."""
    # Stored, so that its size is known before the join and few hits move no text.
    hit = keep(report(docs, items, doc_id, text).where("contaminated").select("doc_id", "tag").distinct())
    rows = boxed(docs, _id=F.col(doc_id).cast("bigint"), _tag=F.xxhash64(F.col(text)))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tag") == F.col("tag"))
    return rows.join(hit, same, "left_anti").select("row.*")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def sql(documents: str = "documents") -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM {documents}),
i AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k
             FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, n, k, item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items,
        string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
