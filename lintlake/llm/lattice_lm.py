"""Scores of texts by a unigram model over the segmentations of their words.

The vocabulary of a public tokenizer gives the pieces; it is read, never changed. A word, with a
blank before it, is a lattice whose edges are the pieces that it contains; bytes that are no
piece are one. The word's probability is the sum over all ways through the lattice of the
product of the pieces' probabilities, by forward recursion in logarithms. A text's probability
is the product over its words and an end. Pieces do not reach across blanks, so no way through a
text is left out.

The file's scores rank its pieces; the starting probability falls with the rank. `ROUNDS`
rounds of expectation and maximisation over all training words then fit the probabilities,
each a pass over the table of distinct words, weighted by their counts, whose expected uses of
pieces are summed before the shuffle.

That table grows with the corpus and is never gathered. Words that make more than a millionth of
the training tokens, a million at most, are sent to all tasks with their counts. Any other word
travels as a hash beside its document's row number and is joined with the table, so the
number of rows on a key is bounded by a millionth of all tokens.

Words are compared by 64-bit hashes where counts are joined. Null texts are empty: one token, the
end. A null id counts as an empty one. Rows that repeat come out each, equal. Without training
documents the starting probabilities stand and no token is known; an empty table gives an empty
result. Texts and words of any length are taken; other columns are not read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm import tokens
from lintlake.sources.store import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U8 = np.uint64
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 5, 1
ROUNDS = 3
#: Expected uses that every piece has besides those in the training words.
PRIOR = 0.1
#: Words beyond this share of the training tokens are known to every task.
COMMON = 1_000_000
#: Words that a task remembers with their probability or count before it starts anew.
_REMEMBERED = 300_000
#: Longer words go through the lattice one by one, in memory of their length.
_LONG = 4096
#: Bytes of words that go through the lattice together.
_TOGETHER = 1 << 19
_BLANK = 32
_MULTIPLIER, _SPREAD, _SLOTS = U8(0x9E3779B97F4A7C15), U8(0xD6E8FEB86659FD93), 20

_WORDS = "hash bigint, word binary, uses bigint"


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def ranked_pieces(path: str) -> list[bytes]:
    """The file's pieces in the order of their scores, as words contain them.

    The mark of a word's begin becomes a blank. Pieces with a blank further in are in no word;
    pieces with capitals are in no lower-cased one. Bytes that are no piece come last.
    """
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    scored = [
        (processor.get_score(k), processor.id_to_piece(k).replace("▁", " ").encode())
        for k in range(processor.get_piece_size())
        if not (processor.is_control(k) or processor.is_unknown(k) or processor.is_byte(k))
    ]
    scored = [(s, piece) for s, piece in scored if b" " not in piece[1:] and piece.lower() == piece]
    made = dict.fromkeys(piece for _, piece in sorted(scored, key=lambda pair: (-pair[0], pair[1])))
    return list(made | dict.fromkeys(bytes([b]) for b in range(256)))


class Lattice:
    """Pieces with the logarithms of their probabilities and of the end's."""

    def __init__(self, pieces: list[bytes], mass: np.ndarray, end: float):
        self.pieces = pieces
        whole = mass.sum() + end
        self.log, self.end = np.log(mass / whole), math.log(end / whole)
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(piece) for piece in pieces], U8)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << _SLOTS, bool)
        self.maybe[self._slot(hashes)] = True
        self.of = {piece: k for k, piece in enumerate(pieces)}

    @classmethod
    def starting(cls, pieces: list[bytes]) -> Lattice:
        """Probabilities that fall with the rank."""
        return cls(pieces, 1 / np.arange(2.0, len(pieces) + 2), 0.5)

    @staticmethod
    def _hash(piece: bytes) -> int:
        made = 0
        for byte in piece:
            made = (made * int(_MULTIPLIER) + byte + 1) % (1 << 64)
        return made

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _SPREAD) >> U8(64 - _SLOTS)).astype(np.int64)

    def edges(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start and end (counted in the word) and piece of every edge, by end."""
        size = np.diff(bounds)
        word = np.repeat(np.arange(len(size)), size)
        left = np.repeat(bounds[1:], size) - np.arange(len(data))
        at, hashes = np.arange(len(data)), np.zeros(len(data), U8)
        found = []
        for length in range(1, self.longest + 1):
            some = left[at] >= length
            at, hashes = at[some], hashes[some]
            if not len(at):
                break
            hashes = hashes * _MULTIPLIER + (data[at + length - 1].astype(U8) + U8(1))
            maybe = np.flatnonzero(self.maybe[self._slot(hashes)])
            place = np.searchsorted(self.hashes, hashes[maybe])
            place[place == len(self.hashes)] = 0
            hit = self.hashes[place] == hashes[maybe]
            begin = at[maybe[hit]]
            start = begin - bounds[word[begin]]
            found.append((word[begin], start, start + length, self.order[place[hit]]))
        made = [np.concatenate(parts) for parts in zip(*found)]
        by_end = np.lexsort((made[0], made[2]))
        return tuple(part[by_end] for part in made)

    @staticmethod
    def _summed(values: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and, of each, the logarithm of the sum of its edges; equal nodes lie together."""
        first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        most = np.maximum.reduceat(values, first)
        shares = np.exp(values - np.repeat(most, np.diff(np.append(first, len(values)))))
        return nodes[first], most + np.log(np.add.reduceat(shares, first))

    def _forward(self, edges, bounds: np.ndarray) -> np.ndarray:
        """Per node, the logarithm of the sum over all ways to it from its word's start."""
        word, start, end, piece = edges
        base = bounds[:-1] + np.arange(len(bounds) - 1)
        reached = np.full(int(bounds[-1]) + len(bounds) - 1, -np.inf)
        reached[base] = 0
        steps = np.searchsorted(end, np.arange(1, int(end[-1]) + 2))
        for low, high in zip(steps[:-1], steps[1:]):
            some = slice(low, high)
            sums = reached[base[word[some]] + start[some]] + self.log[piece[some]]
            nodes, total = self._summed(sums, base[word[some]] + end[some])
            reached[nodes] = total
        return reached

    def log_probabilities(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability; words have a blank before them."""
        made = np.zeros(len(bounds) - 1)
        for low, high in _groups(bounds):
            if high - low == 1 and bounds[high] - bounds[low] > _LONG:
                made[low] = self._long(data[bounds[low] : bounds[high]].tobytes())[-1]
                continue
            own = bounds[low : high + 1] - bounds[low]
            edges = self.edges(data[bounds[low] : bounds[high]], own)
            made[low:high] = self._forward(edges, own)[own[1:] + np.arange(high - low)]
        return made

    def _long(self, word: bytes) -> list[float]:
        """The forward recursion over one word, with all its nodes."""
        reached = [0.0]
        for end in range(1, len(word) + 1):
            ways = [
                reached[start] + self.log[self.of[word[start:end]]]
                for start in range(max(0, end - self.longest), end)
                if word[start:end] in self.of
            ]
            most = max(ways)
            reached.append(most + math.log(sum(math.exp(way - most) for way in ways)))
        return reached

    def expected(self, data: np.ndarray, bounds: np.ndarray, uses: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur so many times."""
        mass = np.zeros(len(self.pieces))
        for low, high in _groups(bounds):
            if high - low == 1 and bounds[high] - bounds[low] > _LONG:
                self._expected_long(data[bounds[low] : bounds[high]].tobytes(), float(uses[low]), mass)
                continue
            own = bounds[low : high + 1] - bounds[low]
            edges = self.edges(data[bounds[low] : bounds[high]], own)
            before = self._forward(edges, own)
            word, start, end, piece = edges
            base = own[:-1] + np.arange(high - low)
            last = own[1:] + np.arange(high - low)
            after = np.full(len(before), -np.inf)
            after[last] = 0
            by_start = np.lexsort((word, start))
            steps = np.searchsorted(start[by_start], np.arange(int(start.max()) + 2))
            for a, b in zip(steps[-2::-1], steps[:0:-1]):
                some = by_start[a:b]
                sums = after[base[word[some]] + end[some]] + self.log[piece[some]]
                nodes, total = self._summed(sums, base[word[some]] + start[some])
                after[nodes] = total
            share = before[base[word] + start] + self.log[piece] + after[base[word] + end] - before[last][word]
            mass += np.bincount(piece, np.exp(share) * uses[low:high][word], len(mass))
        return mass

    def _expected_long(self, word: bytes, uses: float, mass: np.ndarray) -> None:
        before = self._long(word)
        after = [-math.inf] * len(word) + [0.0]
        for start in range(len(word) - 1, -1, -1):
            ways = []
            for end in range(start + 1, min(start + self.longest, len(word)) + 1):
                piece = self.of.get(word[start:end])
                if piece is not None:
                    way = self.log[piece] + after[end]
                    ways.append(way)
                    mass[piece] += uses * math.exp(before[start] + way - before[-1])
            most = max(ways)
            after[start] = most + math.log(sum(math.exp(way - most) for way in ways))


def _groups(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Words that go through the lattice together; a long one goes alone."""
    low, size = 0, np.diff(bounds)
    long = np.append(np.flatnonzero(size > _LONG), len(size))
    while low < len(size):
        if size[low] > _LONG:
            high = low + 1
        else:
            upto = int(np.searchsorted(bounds, bounds[low] + _TOGETHER, "right")) - 1
            high = min(max(upto, low + 1), int(long[np.searchsorted(long, low)]))
        yield low, high
        low = high


def _with_blanks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words laid end to end, a blank before each."""
    return np.insert(data, bounds[:-1], _BLANK), bounds + np.arange(len(bounds))


def _laid_out(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words at these places, end to end, lower-cased."""
    size = stops - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)
    return tokens.lowered()[data[places]], bounds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct words with their uses, in parts of a bounded size."""
    codes = tokens.spaced_words(lower=True)
    uses, word = {}, {}

    def made() -> pa.RecordBatch:
        keys = list(uses)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(keys, U8).view(np.int64)), pa.array([word[k] for k in keys], pa.binary()),
             pa.array(list(uses.values()), pa.int64())],
            names=["hash", "word", "uses"],
        )

    held = 0
    for batch in tokens.small_batches(batches, "text"):
        data, offsets = tokens.text_bytes(batch.column("text"))
        for hashes, starts, stops in tokens.word_pieces(data, offsets, codes):
            keys, first, count = np.unique(hashes, return_index=True, return_counts=True)
            low, bounds = _laid_out(data, starts[first], stops[first])
            low = low.tobytes()
            for key, n, a, b in zip(keys.tolist(), count.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if key in uses:
                    uses[key] += n
                else:
                    uses[key], word[key] = n, low[a:b]
                    held += b - a
            if len(uses) > _REMEMBERED or held > 1 << 26:
                yield made()
                uses.clear()
                word.clear()
                held = 0
    if uses:
        yield made()


def _expectations(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(len(lattice.pieces))
        for batch in batches:
            if batch.num_rows:
                words = _with_blanks(*tokens.text_bytes(batch.column("word")))
                mass += lattice.expected(*words, batch.column("uses").to_numpy().astype(np.float64))
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(mass[some])], names=["piece", "mass"])

    return run


class Model:
    """What the training documents gave: a stored table of words and what every task gets."""

    def __init__(self, words: DataFrame, docs: int, train_tokens: int, distinct: int, lattice: Lattice):
        self.words, self.docs, self.train_tokens, self.lattice = words, docs, train_tokens, lattice
        #: Divides count + 0.5 to a smoothed probability.
        self.whole = train_tokens + 0.5 * (distinct + 1)
        self.common = words.where(F.col("uses") * COMMON > F.lit(train_tokens)).select("hash", "uses")
        self.rare = words.where(F.col("uses") * COMMON <= F.lit(train_tokens)).select("hash", "uses")


def learn(docs: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """Counts over all training documents (doc_id, text), and the fitted lattice."""
    training = docs.where(~held_out(F.col("doc_id"))).select("text")
    words = keep(
        training.mapInArrow(_counted, _WORDS).groupBy("hash", "word").agg(F.sum("uses").alias("uses"))
    )
    count, distinct = words.agg(F.coalesce(F.sum("uses"), F.lit(0)), F.count("*")).first()
    read = training.count()
    lattice = Lattice.starting(ranked_pieces(vocabulary))
    for _ in range(ROUNDS if count else 0):
        parts = words.select("word", "uses").mapInArrow(_expectations(lattice), "piece int, mass double")
        found = parts.groupBy("piece").agg(F.sum("mass").alias("mass")).toArrow()  # a row for a piece at most
        mass = np.full(len(lattice.pieces), PRIOR)
        mass[found["piece"].to_numpy()] += found["mass"].to_numpy()
        lattice = Lattice(lattice.pieces, mass, read + PRIOR)
    return Model(words, read, count + read, distinct + (read > 0), lattice)


_SCORED = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, "
    "score double, rare array<bigint>, uses array<bigint>"
)


def _scored(lattice: Lattice, whole: float, docs: int, hashes: np.ndarray, uses: np.ndarray):
    """Per document, all but what words take that not every task knows; those, with their uses."""
    logs = np.log10((uses + 0.5) / whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = tokens.spaced_words(lower=True), {}

        def probabilities(data, keys, starts, stops) -> np.ndarray:
            listed = keys.tolist()
            if len(seen) > _REMEMBERED:
                seen.clear()
            new = np.array([k for k, key in enumerate(listed) if key not in seen], np.int64)
            if len(new):
                words = _with_blanks(*_laid_out(data, starts[new], stops[new]))
                seen.update(zip(keys[new].tolist(), lattice.log_probabilities(*words).tolist()))
            return np.array([seen[key] for key in listed])

        for batch in tokens.small_batches(batches, "text"):
            data, offsets = tokens.text_bytes(batch.column("text"))
            n = len(offsets) - 1
            n_tokens, known = np.ones(n, np.int64), np.full(n, int(docs > 0), np.int64)
            base, score = np.full(n, math.log10((docs + 0.5) / whole)), np.full(n, lattice.end)
            rare = [np.empty((0, 2), np.int64)]
            for made, starts, stops in tokens.word_pieces(data, offsets, codes):
                keys, first, back = np.unique(made, return_index=True, return_inverse=True)
                doc = np.searchsorted(offsets, starts, "right") - 1
                score += np.bincount(doc, probabilities(data, keys, starts[first], stops[first])[back], n)
                n_tokens += np.bincount(doc, minlength=n)
                place = np.minimum(np.searchsorted(hashes, keys), max(len(hashes) - 1, 0))
                hit = hashes[place] == keys if len(hashes) else np.zeros(len(keys), bool)
                worth = np.where(hit, logs[place], 0) if len(hashes) else np.zeros(len(keys))
                base += np.bincount(doc, worth[back], n)
                known += np.bincount(doc, hit[back], n).astype(np.int64)
                other = np.flatnonzero(~hit[back])
                rare.append(np.stack([doc[other], made[other].view(np.int64)], axis=1))
            pairs, times = np.unique(np.concatenate(rare), axis=0, return_counts=True)
            ends = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens),
                 pa.array(known), pa.array(base), pa.array(score / math.log(10)),
                 pa.ListArray.from_arrays(ends, np.ascontiguousarray(pairs[:, 1])),
                 pa.ListArray.from_arrays(ends, times.astype(np.int64))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "uses"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    common = model.common.toArrow()  # bounded by COMMON rows
    hashes, uses = common["hash"].to_numpy().view(U8), common["uses"].to_numpy()
    order = np.argsort(hashes)
    asked = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "text",
    )
    parts = keep(
        asked.mapInArrow(_scored(model.lattice, model.whole, model.docs, hashes[order], uses[order]), _SCORED)
    )
    words = parts.select("row", F.inline(F.arrays_zip("rare", "uses")))
    counts = model.rare.withColumnRenamed("uses", "count")
    weight = F.log10((F.coalesce("count", F.lit(0)) + F.lit(0.5)) / F.lit(model.whole))
    rest = (
        words.join(counts, words["rare"] == counts["hash"], "left")
        .groupBy(F.col("row").alias("of"))
        .agg(
            F.sum(F.col("uses") * weight).alias("more"),
            F.sum(F.when(F.col("count").isNotNull(), F.col("uses"))).alias("found"),
        )
    )
    return parts.join(rest, parts["row"] == rest["of"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
