"""Language identification by prediction by partial matching.

For each language the counts of bytes after contexts of up to ORDER bytes are taken from a
sample of its documents. A byte's probability is its share after the longest context seen, and
where it was not seen there, the context's escape probability times that after the context one
byte shorter (method C, without exclusions), down to all bytes alike. The counts are frozen,
so every byte has an exact code length in each language; the language that codes the whole
text shortest is predicted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import tokens
from lintlake.llm.columns import held_out
from lintlake.sources.store import keep, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
#: Documents of a language that are learned from, and of all languages together, at most.
SAMPLE = 400
SAMPLE_ALL = 40_000
#: Bytes of all their texts, and of one, at most: longer documents are not learned from.
SAMPLE_BYTES = 256 * 1024 * 1024
LONGEST = SAMPLE_BYTES // 16
#: Numbers in the model's largest table, grams times languages, at most. Beyond it the grams
#: with fewest uses are left out.
CELLS = 1 << 27
UNKNOWN = "und"
_PAD = 10  # what stands before a text
_PIECE = 1 << 17

_GRAMS = "lang string, gram bigint, uses bigint"
_PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double"
U8 = np.uint64


def _keys(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each byte of a piece the ORDER bytes before it in its text, and itself, as a number."""
    made = data[low:high].astype(U8)
    begins = offsets[np.searchsorted(offsets, low - ORDER) : np.searchsorted(offsets, high)]
    for back in range(1, ORDER + 1):
        before = np.full(high - low, _PAD, U8)
        own = data[max(low - back, 0) : max(high - back, 0)]
        before[high - low - len(own) :] = own
        # The first bytes of a text have others' bytes before them.
        pad = (begins[:, None] + np.arange(back)).ravel() if len(begins) else begins
        pad = pad[(pad >= low) & (pad < high)]
        owner = np.searchsorted(offsets, pad, "right") - 1
        pad = pad[pad - offsets[owner] < back]
        before[pad - low] = _PAD
        made |= before << U8(8 * back)
    return made


def _of_order(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & U8((1 << (8 * (order + 1))) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each gram of ORDER + 1 bytes by language."""
    for batch in tokens.small_batches(batches, "text"):
        langs = batch.column("lang").to_pylist()
        data, offsets = tokens.text_bytes(batch.column("text"))
        names, at = np.unique(np.array(langs, dtype=object), return_inverse=True)
        owner = np.repeat(at, np.diff(offsets))
        for low in range(0, len(data), 1 << 20):
            high = min(low + (1 << 20), len(data))
            keys = _keys(data, offsets, low, high)
            for k, name in enumerate(names):
                grams, uses = np.unique(keys[owner[low:high] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(uses)],
                    names=["lang", "gram", "uses"],
                )


def sample(docs: DataFrame) -> DataFrame:
    """doc_id, lang and rank of the documents to learn from: the SAMPLE of least hash per language.

    Ids are counted by language first; then only those go on whose hash is below what twice the
    sample needs, so that a language with most documents is not ranked as a whole. An id that is
    repeated counts once.
    """
    known = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    ids = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    # Bounded: at most SAMPLE_ALL short rows.
    most = F.broadcast(ids.orderBy("lang").limit(SAMPLE_ALL))
    below = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), 2 * SAMPLE / F.col("ids"))
    few = known.join(most, "lang").where(F.col("hash").cast("double") <= below).select("doc_id", "lang", "hash").distinct()
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    ranked = few.withColumn("rank", F.row_number().over(order))
    drawn = ranked.where(F.col("rank") <= SAMPLE).orderBy("rank", "lang").limit(SAMPLE_ALL)
    return drawn.select("doc_id", "lang", "rank")


class Model:
    """Code lengths, per language, of bytes after contexts."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, uses: np.ndarray):
        self.langs = langs
        self.orders = []  # from ORDER down to 1: (grams, lengths, contexts, lengths of escapes)
        below = None
        for order in range(ORDER + 1):
            keys, place = np.unique(_of_order(gram, order), return_inverse=True)
            counts = np.zeros((len(keys), len(langs)))
            np.add.at(counts, (place, lang), uses)
            contexts, at = np.unique(keys >> U8(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, at, counts)
            np.add.at(kinds, at, counts > 0)
            seen = total > 0
            both = np.where(seen, total + kinds, 1)
            escape = np.where(seen, -np.log2(np.where(seen, kinds, 1) / both), 0.0)
            if order == 0:
                shorter = np.full((len(keys), len(langs)), 8.0)
            else:
                previous, lengths = below
                shorter = lengths[np.searchsorted(previous, _of_order(keys, order - 1))]
            own = -np.log2(np.where(counts > 0, counts, 1) / both[at])
            below = keys, np.where(counts > 0, own, escape[at] + shorter)
            if order:
                # The first byte of a key is what its context begins with: keys sort by context.
                self.orders.insert(0, (_Table(keys, below[1]), _Table(contexts, escape)))
            else:
                self.single = np.full((256, len(langs)), 8.0) + escape.sum(axis=0)
                self.single[keys.astype(np.int64)] = below[1]

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        """A row of code lengths for each key, in bits."""
        made = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for order, (grams, contexts) in zip(range(ORDER, 0, -1), self.orders):
            own = _of_order(keys[left], order)
            found, row = grams.find(own)
            if order == ORDER:
                made[found] = grams.rows[row]
            else:
                made[left[found]] += grams.rows[row]
            missed = ~found
            left, own = left[missed], own[missed]
            if not len(left):
                return made
            known, row = contexts.find(own >> U8(8))
            made[left[known]] += contexts.rows[row]
        made[left] += self.single[(keys[left] & U8(255)).astype(np.int64)].astype(np.float32)
        return made


class _Table:
    """Rows by 64-bit key, found for many keys at once: hashing in a few rounds."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.rows = rows.astype(np.float32)
        size = max(3 + int(len(keys)).bit_length(), 4)
        self.rounds, left = [], np.arange(len(keys))
        factor = 0x9E3779B97F4A7C15
        while len(left):
            slots, entry = np.zeros(1 << size, U8), np.full(1 << size, -1, np.int32)
            place = self._place(keys[left], factor, size)
            first = np.unique(place, return_index=True)[1]
            slots[place[first]], entry[place[first]] = keys[left[first]], left[first]
            self.rounds.append((factor, size, slots, entry))
            left = np.delete(left, first)
            size, factor = max(3 + int(len(left)).bit_length(), 4), (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    @staticmethod
    def _place(keys: np.ndarray, factor: int, size: int) -> np.ndarray:
        return ((keys * U8(factor)) >> U8(64 - size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the row of each that is."""
        row = np.full(len(keys), -1, np.int32)
        left = None
        for factor, size, slots, entry in self.rounds:
            asked = keys if left is None else keys[left]
            place = self._place(asked, factor, size)
            hit = (slots[place] == asked) & (entry[place] >= 0)
            if left is None:
                row[hit] = entry[place[hit]]
                left = np.flatnonzero(~hit)
            else:
                row[left[hit]] = entry[place[hit]]
                left = left[~hit]
            if not len(left):
                break
        found = row >= 0
        return found, row[found]


def _within_bytes(texts: DataFrame) -> DataFrame:
    """The sample's texts, in the order of their ranks, up to SAMPLE_BYTES; an id goes as a whole."""
    sizes = texts.groupBy("rank", "lang", "doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    # One task, of at most SAMPLE_ALL short rows.
    so_far = F.sum("bytes").over(Window.orderBy("rank", "lang", "doc_id"))
    fits = sizes.where(F.col("bytes") <= LONGEST).withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES)
    return texts.join(F.broadcast(fits.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")


def _within_cells(grams: DataFrame) -> DataFrame:
    """The grams used most, of those that are used alike all or none, up to CELLS."""
    langs = grams.agg(F.count_distinct("lang")).first()[0]
    totals = grams.groupBy("gram").agg(F.sum("uses").alias("all_uses"))
    # A row for each number of uses, which the sample's bytes bound.
    sizes = totals.groupBy("all_uses").count().orderBy(F.desc("all_uses")).collect()
    taken, least = 0, None
    for row in sizes:
        taken += row["count"] * langs
        if taken > CELLS:
            break
        least = row["all_uses"]
    else:
        return grams
    if least is None:
        return grams.limit(0)
    return grams.join(totals.where(F.col("all_uses") >= least), "gram", "left_semi")


def learn(docs: DataFrame) -> Model:
    """Counts over the sample, which is bounded in documents and bytes. The model is built here.

    `docs` has doc_id, text and lang. Held-out documents and those without lang are not read.
    A sampled document longer than LONGEST is not learned from.
    """
    chosen = sample(docs)  # at most SAMPLE_ALL short rows
    texts = keep(docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]))
    counted = _within_bytes(texts).mapInArrow(_counted, _GRAMS)
    grams = keep(counted.groupBy("lang", "gram").agg(F.sum("uses").alias("uses")))
    rows = _within_cells(grams).toArrow()
    release(texts, grams)
    langs = sorted(set(rows["lang"].to_pylist()))
    number = {name: k for k, name in enumerate(langs)}
    lang = np.array([number[name] for name in rows["lang"].to_pylist()], np.int64)
    return Model(langs, lang, rows["gram"].to_numpy().view(U8), rows["uses"].to_numpy())


def _has_letter(text: str) -> bool:
    return any(char.isalpha() for char in text)


def _scored(model: Model):
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.small_batches(batches, "text"):
            column = batch.column("text")
            data, offsets = tokens.text_bytes(column)
            docs = len(column)
            bits, letters = np.zeros((docs, len(model.langs))), np.zeros(docs, np.int64)
            for low in range(0, len(data), _PIECE):
                high = min(low + _PIECE, len(data))
                first = int(np.searchsorted(offsets, low, "right")) - 1
                last = int(np.searchsorted(offsets, high, "left")) - 1
                spans = np.maximum(offsets[first : last + 1], low) - low
                some = np.flatnonzero(np.diff(np.append(spans, high - low)) > 0)
                own = first + some
                lengths = model.lengths(_keys(data, offsets, low, high))
                bits[own] += np.add.reduceat(lengths, spans[some], axis=0, dtype=np.float64)
                letters[own] += np.add.reduceat(ascii_letter[data[low:high]].astype(np.int64), spans[some])
            silent = [k for k in np.flatnonzero(letters == 0).tolist() if not _has_letter(column[k].as_py() or "")]
            if model.langs:
                best = bits.argmin(axis=1)
                names = np.array(model.langs, dtype=object)[best]
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            else:
                names, share = np.full(docs, UNKNOWN, dtype=object), np.zeros(docs)
            names[silent], share[silent] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(share)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The score is the predicted language's share of the probability that all languages give the
    text. A null text or one without a letter is `und`, with score 0; so is all where nothing
    was learned. Ties go to the language first by name. Equal rows give equal rows.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return chosen.mapInArrow(_scored(model), _PREDICTED)
