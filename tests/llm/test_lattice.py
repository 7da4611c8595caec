"""Lattice scores against sums over all segmentations, counts against plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import lattice_lm, tokens
from tests.llm import cases


def lattice(pieces=(b" a", b" ", b"ab", b"aba", b"b", b"ba", b" ab")):
    return lattice_lm.Lattice.starting(list(dict.fromkeys([*pieces, *[bytes([b]) for b in range(256)]])))


def all_ways(model, word: bytes):
    """Every segmentation of a word as its list of pieces."""
    if not word:
        yield []
    for size in range(1, min(len(word), model.longest) + 1):
        if word[:size] in model.of:
            for rest in all_ways(model, word[size:]):
                yield [model.of[word[:size]], *rest]


def laid_out(words):
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])


@given(st.lists(st.text("ab cé", min_size=1, max_size=9).map(str.encode), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_lattice(words):
    model = lattice()
    made = model.log_probabilities(*laid_out(words))
    uses = np.arange(1.0, len(words) + 1)
    mass = np.zeros(len(model.pieces))
    for k, word in enumerate(words):
        ways = [(math.exp(sum(model.log[p] for p in way)), way) for way in all_ways(model, word)]
        whole = sum(p for p, _ in ways)
        assert math.isclose(made[k], math.log(whole), rel_tol=1e-9)
        for p, way in ways:
            for piece in way:
                mass[piece] += uses[k] * p / whole
    assert np.allclose(model.expected(*laid_out(words), uses), mass)


def test_long_words_one_by_one(monkeypatch):
    rng = random.Random(2)
    words = [b" " + bytes(rng.choice(b"abc\xc3\xa9") for _ in range(n)) for n in (1, 3, 40, 2, 90, 5)]
    model = lattice()
    many = model.log_probabilities(*laid_out(words)), model.expected(*laid_out(words), np.arange(6.0))
    monkeypatch.setattr(lattice_lm, "_LONG", 4)
    monkeypatch.setattr(lattice_lm, "_TOGETHER", 8)
    single = model.log_probabilities(*laid_out(words)), model.expected(*laid_out(words), np.arange(6.0))
    assert np.allclose(many[0], single[0]) and np.allclose(many[1], single[1])


def test_pieces_of_the_vocabulary():
    pieces = lattice_lm.ranked_pieces(lattice_lm.VOCABULARY)
    assert len(pieces) == len(set(pieces)) > 20_000 and pieces[0] == b" t"
    assert all(bytes([b]) in pieces for b in range(256))
    assert not any(b" " in p[1:] or p.lower() != p for p in pieces if len(p) > 1)


def low(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def brute(rows, model):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    counts = Counter()
    for doc_id, text in rows:
        if fold(doc_id) != 1:
            counts.update([*words_of(text), None])
    n, v = sum(counts.values()), len(counts)

    @lru_cache(None)
    def lattice_score(word):
        data = b" " + word.encode()
        reached = [0.0]
        for end in range(1, len(data) + 1):
            ways = [
                reached[a] + model.lattice.log[model.lattice.of[data[a:end]]]
                for a in range(max(0, end - model.lattice.longest), end) if data[a:end] in model.lattice.of
            ]
            most = max(ways)
            reached.append(most + math.log(sum(math.exp(w - most) for w in ways)))
        return reached[-1]

    out = []
    for doc_id, text in rows:
        said = [*words_of(text), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in said)
        score = (model.lattice.end + sum(lattice_score(w) for w in said[:-1])) / math.log(10)
        out.append((doc_id, fold(doc_id) == 1, len(said), sum(counts[w] > 0 for w in said), n, base, score))
    return sorted(out, key=lambda row: (row[0] is None, row[0] or 0, row[2:]))


def compare(got, want):
    got = sorted((tuple(r) for r in got), key=lambda row: (row[0] is None, row[0] or 0, row[2:]))
    assert [row[:5] for row in got] == [row[:5] for row in want]
    for row, other in zip(got, want):
        assert row[5:] == pytest.approx(other[5:], rel=1e-9)


@pytest.mark.parametrize("common", [1_000_000, 3])
def test_scores(spark, docs, monkeypatch, common):
    """Whether most words are known to every task or none, the scores are the same."""
    monkeypatch.setattr(lattice_lm, "COMMON", common)
    model = lattice_lm.learn(docs.repartition(4))
    got = lattice_lm.score(docs.repartition(3), model)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compare(got.collect(), brute([row[:2] for row in cases.rows()], model))


def test_scores_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lattice_lm.learn(docs)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    compare(lattice_lm.score(docs, model).collect(), brute(rows, model))
    counts = Counter(w for doc_id, text in rows if fold(doc_id) != 1 for w in words_of(text))
    assert {bytes(r["word"]).decode(): r["uses"] for r in model.words.collect()} == counts
    # Fitting makes the training words likelier than the starting probabilities do.
    words = [b" " + w.encode() for w in counts]
    uses = np.array(list(counts.values()))
    start = lattice_lm.Lattice.starting(model.lattice.pieces).log_probabilities(*laid_out(words))
    assert (model.lattice.log_probabilities(*laid_out(words)) * uses).sum() > (start * uses).sum()


def test_nothing_to_learn_from(spark, docs, none):
    model = lattice_lm.learn(none)
    assert lattice_lm.score(none, model).count() == 0
    assert {(r["n_known"], r["train_tokens"]) for r in lattice_lm.score(docs, model).collect()} == {(0, 0)}


def test_a_very_long_text(spark):
    """Ten million characters, and a word of a hundred thousand."""
    text = "ab cd " * 1_700_000 + "x" * 100_000
    docs = spark.createDataFrame([(1, text), (2, "ab")], "doc_id bigint, text string")
    model = lattice_lm.learn(docs)
    first = next(r for r in lattice_lm.score(docs, model).collect() if r["doc_id"] == 1)
    assert first["n_tokens"] == 3_400_002 and math.isfinite(first["score"])


def test_zero_bytes_are_their_own(spark):
    column = pa.array(["\x00 \x01 \x02", "\x00\x01 \x01\x00"])
    hashes, bounds = tokens.words(*tokens.text_bytes(column), tokens.spaced_words(lower=True))
    assert len(set(hashes.tolist())) == 5 and bounds.tolist() == [0, 3, 5]
