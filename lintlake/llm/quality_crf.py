"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features, with those of the lines before and after it, and
the states' transitions score a labelling; forward-backward gives each line's probability to
be good. Their mean, weighted by length, is the document's quality, which one logistic curve
turns into a score. Labels are by document: lines start with their document's label, then
those of bad documents are labelled anew by the field itself, and it is fitted again.
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

#: Labelled documents that the field is fitted to, at most.
SAMPLE = 2_000
#: Lines of all of them, and of one, at most: the field is not fitted to texts of more lines.
SAMPLE_LINES = 400_000
MOST_LINES = SAMPLE_LINES // 8
GOOD = 0.7
_STEPS = 150
_ROUNDS = 3

_FEATURES = "doc_id bigint, quality int, lines array<array<float>>, weights array<int>"
_SCORED = "doc_id bigint, held_out boolean, score double, predicted int"
# Kinds of bytes whose share in a line is a feature.
_KINDS = [b"#*$%&<>", b"|", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:", b" \t"]
_RAW = len(_KINDS) + 6


def _flags(kind: bytes) -> np.ndarray:
    flags = np.zeros(256, np.uint8)
    flags[list(kind)] = 1
    return flags


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over ranges that bounds part, also of empty ones."""
    made = np.add.reduceat(np.append(values, 0), bounds[:-1], dtype=np.int64)
    made[bounds[1:] == bounds[:-1]] = 0
    return made


def _said_before(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Whether a key was met before in its part of the array."""
    before = np.ones(len(keys), np.uint8)
    for low, high in zip(parts[:-1].tolist(), parts[1:].tolist()):
        if high > low:
            before[low + np.unique(keys[low:high], return_index=True)[1]] = 0
    return before


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their weights, and where each text's lines begin, with the end.

    A text without a line break is one line, an empty or null one an empty line.
    """
    data, offsets = tokens.text_bytes(column)
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks]), kind="stable")
    # Where a text ends in a break, the next text and the line behind the break begin at one place.
    begins = np.searchsorted(breaks, offsets[:-1], "left") + np.arange(len(column))
    # A break that is a text's last byte starts an empty line of that text.
    at_end = np.isin(offsets[1:], breaks) & (np.diff(offsets) > 0)
    begins[1:] += at_end[:-1]
    bounds = np.append(begins, len(starts))
    edges = np.append(starts, len(data))
    length = np.diff(edges)
    size = np.maximum(length, 1)
    shares = [_sums(_flags(kind)[data], edges) / size for kind in _KINDS]
    hashes, own = tokens.words(data, edges, tokens.spaced_words(lower=False))
    n_words = np.diff(own)
    some = np.maximum(n_words, 1)
    again = np.zeros(len(hashes), np.uint8)
    again[1:] = hashes[1:] == hashes[:-1]
    three = tokens.grams(hashes, 3)
    said = np.zeros(len(hashes), np.uint8)
    of_text = np.minimum(own[bounds], len(three))
    said[: len(three)] = _said_before(three, of_text)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mixed(hashes), dtype=np.uint64)])
    line_key = sums[own[1:]] - sums[own[:-1]]
    repeated = _said_before(line_key, bounds) * (n_words > 2)
    raw = np.stack(
        [
            *shares,
            _sums(again, own) / some,
            _sums(said, own) / some,
            repeated,
            np.log1p(length) / 5,
            length / some / 10,
            n_words == 0,
        ],
        axis=1,
    )
    before, after = np.zeros_like(raw), np.zeros_like(raw)
    before[1:], after[:-1] = raw[:-1], raw[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    made = np.concatenate([raw, before, after, np.ones((len(raw), 1))], axis=1)
    return np.clip(made, 0, 3).astype(np.float32), length + 1, bounds


def _chains(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the texts' chains, longest first."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    return bounds[:-1][order], lengths[order]


def marginals(logits: np.ndarray, steps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of each line to be good, expected transitions (2 x 2), and the log of the
    texts' normalisers. State 1 is good: its score is the logit, that of state 0 is 0."""
    starts, lengths = _chains(bounds)
    n = len(logits)
    node = np.stack([np.zeros(n), logits], axis=1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest + 1)]
    for t in range(longest):
        at = starts[: active[t]]
        at = at[lengths[: len(at)] > t] + t
        if t == 0:
            forward[at] = node[at]
        else:
            past = forward[at - 1]
            forward[at] = node[at] + np.logaddexp(past[:, :1] + steps[0], past[:, 1:] + steps[1])
    moves = np.zeros((2, 2))
    last = starts + lengths - 1
    total = np.logaddexp(forward[last, 0], forward[last, 1])
    for t in range(longest - 2, -1, -1):
        rows = np.flatnonzero(lengths > t + 1)
        at = starts[rows] + t
        ahead = node[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(steps[:, 0] + ahead[:, :1], steps[:, 1] + ahead[:, 1:])
        pair = forward[at][:, :, None] + steps + ahead[:, None, :] - total[rows][:, None, None]
        moves += np.exp(pair).sum(axis=0)
    both = forward + backward
    good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
    return good, moves, float(total.sum())


def fit(features: np.ndarray, labels: np.ndarray, bounds: np.ndarray, start=None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that make the lines' labels most likely, with a small prior."""
    n = len(labels)
    weights, steps = (np.zeros(features.shape[1]), np.zeros((2, 2))) if start is None else start
    inner = np.ones(n, bool)
    inner[bounds[:-1]] = False
    pairs = np.zeros((2, 2))
    here = np.flatnonzero(inner)
    np.add.at(pairs, (labels[here - 1], labels[here]), 1)
    # Adam: first and second moments of the gradient.
    packed = np.concatenate([weights, steps.ravel()])
    mean, square = np.zeros_like(packed), np.zeros_like(packed)
    for k in range(1, _STEPS + 1):
        weights, steps = packed[:-4], packed[-4:].reshape(2, 2)
        good, moves, _ = marginals(features @ weights, steps, bounds)
        gradient = np.concatenate([features.T @ (labels - good), (pairs - moves).ravel()]) / n - 1e-4 * packed
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        packed = packed + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return packed[:-4], packed[-4:].reshape(2, 2)


def _quality(good: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The texts' mean of their lines' probabilities, weighted by length."""
    return np.add.reduceat(good * weights, bounds[:-1]) / np.add.reduceat(weights, bounds[:-1])


def _curve(quality: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from quality to label, by Newton's method."""
    x = np.stack([quality, np.ones_like(quality)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, x.T @ (labels - p) - 0.05 * beta), -3, 3)
    return float(beta[0]), float(beta[1])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tokens.small_batches(batches, "text"):
        features, weights, bounds = line_features(batch.column("text"))
        ends = pa.array(bounds.astype(np.int32))
        width = features.shape[1]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, features.size + 1, width, dtype=np.int32)), pa.array(features.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.ListArray.from_arrays(ends, rows),
             pa.ListArray.from_arrays(ends, pa.array(weights.astype(np.int32)))],
            names=["doc_id", "quality", "lines", "weights"],
        )


def _within_lines(texts: DataFrame) -> DataFrame:
    """The sample's texts in the order of their hash up to SAMPLE_LINES; an id goes as a whole."""
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    sizes = texts.groupBy("doc_id").agg(F.sum(lines).alias("lines"))
    # One task, of at most SAMPLE short rows.
    so_far = F.sum("lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = sizes.where(F.col("lines") <= MOST_LINES).withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_LINES)
    return texts.join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Fit the field and the curve to a sample of labelled documents that are not held out.

    The sample is the SAMPLE labelled ids of least hash among those the table has; an id labelled
    twice counts once, as bad if either says so. The driver gets the sample's line features, of at
    most SAMPLE_LINES lines. Without a label of either kind all texts score one half.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("quality"))
    )
    present = docs.select("doc_id").distinct()
    drawn = known.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = keep(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))
    rows = _within_lines(texts).mapInArrow(_sampled, _FEATURES).toArrow().sort_by("doc_id")
    release(texts)
    quality = rows["quality"].to_numpy()
    if len(set(quality.tolist())) < 2:
        return {}
    lines = rows["lines"].combine_chunks()
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows["weights"].to_pylist()])])
    features = np.array(lines.flatten().flatten()).reshape(bounds[-1], -1).astype(np.float64)
    weights = np.concatenate([np.array(x) for x in rows["weights"].to_pylist()])
    # Features on one scale, so that rare kinds of bytes weigh as much as lengths.
    scale = 1 / np.maximum(features.std(axis=0), 1e-3)
    scale[-1] = 1.0
    features *= scale
    of_text = np.repeat(quality, np.diff(bounds))
    labelled, field = of_text.copy(), None
    for _ in range(_ROUNDS):
        field = fit(features, labelled, bounds, field)
        good, _, _ = marginals(features @ field[0], field[1], bounds)
        # Lines of bad texts as the field sees them, their worst line bad in any case.
        worst = np.repeat(np.minimum.reduceat(good, bounds[:-1]), np.diff(bounds))
        labelled = np.where(of_text == 1, 1, ((good > 0.5) & (good > worst)).astype(of_text.dtype))
    slope, offset = _curve(_quality(good, weights, bounds), quality)
    return {"weights": field[0] * scale, "steps": field[1], "slope": slope, "offset": offset}


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.small_batches(batches, "text"):
            if model:
                features, weights, bounds = line_features(batch.column("text"))
                good, _, _ = marginals(features @ model["weights"], model["steps"], bounds)
                value = model["slope"] * _quality(good, weights, bounds) + model["offset"]
                score = 1 / (1 + np.exp(-np.clip(value, -500, 500)))
            else:
                score = np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= GOOD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of GOOD on).

    Only the text is read for a score; a null text is as an empty one. Equal rows give equal
    rows, an empty table an empty one.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return chosen.mapInArrow(_scorer(model), _SCORED)
