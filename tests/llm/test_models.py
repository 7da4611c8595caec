"""Chat formatting, mixing, the field over lines and code lengths."""

import itertools
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.llm import chat, language_id, mixing, quality_crf, tokens
from tests.llm import cases

TEXT = st.text(st.sampled_from(list("a<|[]>\\/INSTs \né")) | st.characters(codec="utf-8"), max_size=30)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys|>", ""]), TEXT), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(messages):
    formatted, loss = chat.render([list(m) for m in messages])
    assert chat.read_back(formatted) == messages
    texts = [chat.unescaped(formatted[s["start"] : s["end"]]) for s in loss]
    assert texts == [t for r, t in messages if r == "assistant"]
    for _, text in messages:
        for mark in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert mark not in chat.escaped(text)


def test_chat_events(spark):
    events = [
        (1, 0, "user", "Hi", "message"), (1, 1, "assistant", "He", "delta"), (1, 2, "assistant", "llo", "delta"),
        (1, 3, "assistant", "", "regenerate"), (1, 4, "assistant", "Hey", "delta"), (1, 5, "user", "more", None),
        (1, 6, "assistant", "gone", None), (1, 7, "user", "less", "edit"), (1, 8, "assistant", "ok", "regenerate"),
        (2, None, None, None, None), (2, 0, "user", "b", None), (2, 0, "user", "a", None), (2, 0, "user", "a", None),
        (None, 1, "assistant", "x", None),
    ]
    random.Random(1).shuffle(events)
    table = spark.createDataFrame(events, "conv_id bigint, turn bigint, role string, text string, kind string").repartition(4)
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.format_chats(table, kind="kind").collect()}
    assert got[1] == [("user", "Hi"), ("assistant", "Hey"), ("user", "less"), ("assistant", "ok")]
    assert got[2] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")] and got[None] == [("assistant", "x")]
    assert chat.digest(chat.format_chats(table.limit(0))).count() == 0


def brute_targets(sizes):
    """Share again and again until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / whole for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": int(10 ** rng.uniform(0, 5)) * (rng.random() > 0.1) for k in range(rng.randrange(1, 30))}
    sizes[None] = rng.randrange(1000)
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    want = brute_targets(sizes)
    assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6) for r in got)
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()), rel_tol=1e-9)


def test_mix(spark, docs, none):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randrange(0, 400), f"s{min(k % 9, 4)}") for k in range(600)] + [(1000, "w " * 30_000, None), (7, None, "s1")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sized, mixed = mixing.mix(table, slot_words=64)
    pieces, lines = mixed.collect(), sized.collect()
    per_slot, source_of = Counter(), {}
    for p in pieces:
        per_slot[p["position"]] += p["words"]
        assert source_of.setdefault(p["position"], p["source"]) == p["source"]
    goal = {r["source"]: r["target"] for r in lines}
    got = Counter()
    for p in pieces:
        got[p["source"]] += p["words"]
    assert all(abs(got[s] - goal[s]) <= 1 for s in goal)
    assert max(per_slot.values()) == 64 and sum(v < 64 for v in per_slot.values()) <= 2 * len(goal)
    # Every stretch of the mix has the shares nearly.
    order = [source_of[k] for k in sorted(source_of)]
    head, share = Counter(order[: len(order) // 4]), Counter(order)
    assert all(abs(4 * head[s] - share[s]) <= 24 + 0.05 * share[s] for s in share)
    again = sorted(map(tuple, mixing.taken(table.repartition(5)).collect()), key=repr)
    assert sorted(map(tuple, mixing.taken(table).collect()), key=repr) == again
    assert len(again) == len(rows) and all(r[4] <= 2 * r[1] for r in again)
    assert mixing.taken(docs).count() == docs.count() and mixing.taken(none).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    for lengths in ([1], [3, 1, 5], [2, 2]):
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        logits, steps = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2))
        good, moves, _ = quality_crf.marginals(logits, steps, bounds)
        want, want_moves = np.zeros(len(logits)), np.zeros((2, 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            paths = list(itertools.product((0, 1), repeat=b - a))
            weight = [math.exp(sum(logits[a + i] for i, s in enumerate(p) if s) + sum(steps[s, t] for s, t in zip(p, p[1:]))) for p in paths]
            for p, w in zip(paths, weight):
                want[a:b] += np.array(p) * w / sum(weight)
                for s, t in zip(p, p[1:]):
                    want_moves[s, t] += w / sum(weight)
        assert np.allclose(good, want) and np.allclose(moves, want_moves)


def test_lines_of_texts():
    texts = ["a\n", "b c\n\nd", None, "", "x\n\n", "y", "\n", "é | é"]
    _, weights, bounds = quality_crf.line_features(pa.array(texts))
    want = [[len(line.encode()) + (1 if k == n - 1 else 2) for k, line in enumerate(lines)]
            for lines in ((t or "").split("\n") for t in texts) for n in [len(lines)]]
    assert [weights[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


def test_quality(spark, docs, none):
    rows, labels = [], []
    for k in range(300):
        text = cases.prose(k, 60) if k % 3 else cases.prose(k, 10) + "\n" + "buy$$$ now!! " * 30
        rows.append((k, text))
        labels.append((k, int(k % 3 > 0)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(0, None), (None, 1), (3, 1)], "doc_id bigint, quality int")
    model = quality_crf.learn(table, marks)
    got = quality_crf.score(table, model).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 300 and sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    assert quality_crf.score(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality_crf.score(none, model).count() == 0
    nothing = quality_crf.learn(table, marks.limit(0))
    assert {(r["score"], r["predicted"]) for r in quality_crf.score(table, nothing).collect()} == {(0.5, 0)}


def plain_lengths(samples, text):
    """Code length of a text in each language, counted and coded the plain way."""
    made = {}
    for lang, texts in samples.items():
        counts = defaultdict(Counter)
        for sample in texts:
            data = b"\n" * 4 + sample.encode()
            for at in range(4, len(data)):
                for order in range(5):
                    counts[data[at - order : at]][data[at]] += 1
        bits, data = 0.0, b"\n" * 4 + text.encode()
        for at in range(4, len(data)):
            for order in range(4, -1, -1):
                after = counts[data[at - order : at]]
                whole = sum(after.values()) + len(after)
                if after[data[at]]:
                    bits -= math.log2(after[data[at]] / whole)
                    break
                if sum(after.values()):
                    bits -= math.log2(len([v for v in after.values() if v]) / (sum(after.values()) + len([v for v in after.values() if v])))
            else:
                bits += 8
        made[lang] = bits
    return made


def test_code_lengths():
    samples = {"a": ["the cat sat on the mat", "that hat"], "b": ["der hund und die katze", "und\nder"]}
    rows = Counter()
    for k, lang in enumerate(sorted(samples)):
        for sample in samples[lang]:
            data, offsets = tokens.text_bytes(pa.array([sample]))
            for gram in language_id._keys(data, offsets, 0, len(data)).tolist():
                rows[k, gram] += 1
    lang, gram = (np.array(x) for x in zip(*rows))
    model = language_id.Model(sorted(samples), lang, gram.astype(np.uint64), np.array(list(rows.values())))
    for text in ["the", "und der hat", "x", "\n\nthé", "the cat sat on the mat"]:
        data, offsets = tokens.text_bytes(pa.array([text]))
        bits = model.lengths(language_id._keys(data, offsets, 0, len(data))).sum(axis=0)
        assert np.allclose(bits, list(plain_lengths(samples, text).values()), rtol=1e-4)


def test_contexts_do_not_cross_texts():
    texts = pa.array(["ab", "", "c", "defghij", None, "k"])
    data, offsets = tokens.text_bytes(texts)
    whole = language_id._keys(data, offsets, 0, len(data))
    want = []
    for text in texts.to_pylist():
        padded = b"\n" * 4 + (text or "").encode()
        want += [int.from_bytes(padded[k : k + 5], "big") for k in range(len(padded) - 4)]
    assert whole.tolist() == want
    for cut in range(1, len(data)):
        parts = [language_id._keys(data, offsets, 0, cut), language_id._keys(data, offsets, cut, len(data))]
        assert np.concatenate(parts).tolist() == want


def test_languages(spark, docs, none):
    rng = random.Random(3)
    words = {"de": ["der", "und", "nicht", "schön"], "en": ["the", "and", "with", "thing"], "fr": ["le", "été", "avec", "que"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for k in range(600) for lang in [sorted(words)[k % 3]]]
    rows += [(700, None, "en"), (701, "123 !?", "de"), (702, "", None), (703, "the and", None), (704, "été", None), (705, "ß 1", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.learn(table)
    got = {r["doc_id"]: r for r in language_id.predict(table, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:600])
    assert {got[k]["lang_pred"] for k in (700, 701, 702)} == {"und"} and got[700]["score"] == 0
    assert got[703]["lang_pred"] == "en" and got[704]["lang_pred"] == "fr" and got[705]["lang_pred"] != "und"
    assert language_id.predict(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert language_id.predict(none, language_id.learn(none)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(table, language_id.learn(none)).collect()} == {"und"}


def test_languages_against_the_plain_coder(spark):
    """The whole of it: what is learned from, every code length, the choice and its score."""
    rng = random.Random(5)
    words = {"de": ["der", "und", "nicht", "schön"], "en": ["the", "and", "und", "thing"], "fr": ["le", "été", "der", "que"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 6))), lang)
            for k in range(90) for lang in [sorted(words)[k % 3]]]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    samples = {lang: [text for _, text, own in learned if own == lang] for lang in words}
    got = {r["doc_id"]: r for r in language_id.predict(table, language_id.learn(table)).collect()}
    for doc_id, text, _ in rows:
        bits = plain_lengths(samples, text)
        share = {lang: 1 / sum(2 ** (own - other) for other in bits.values()) for lang, own in bits.items()}
        assert got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert share[got[doc_id]["lang_pred"]] >= max(share.values()) - 1e-3
        assert abs(got[doc_id]["score"] - max(share.values())) < 1e-3


def test_language_sample_is_the_least_by_hash(spark, monkeypatch):
    """Also where ids are repeated and one language has most of them."""
    monkeypatch.setattr(language_id, "SAMPLE", 20)
    rows = [(k, "en") for k in range(2000)] + [(k, "de") for k in range(5000, 5030)] + [(7, "en")] * 500 + [(8, None), (None, "en")]
    table = spark.createDataFrame(rows, "doc_id bigint, lang string")
    hashed = {(r["doc_id"], r["lang"]): r["h"] for r in table.dropna().selectExpr("*", "xxhash64(doc_id) h").collect()
              if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    want = {lang: sorted((h, k) for (k, own), h in hashed.items() if own == lang)[:20] for lang in ("en", "de")}
    got = language_id.sample(table).collect()
    assert {(r["lang"], r["doc_id"], r["rank"]) for r in got} == {
        (lang, k, n + 1) for lang, ranked in want.items() for n, (_, k) in enumerate(ranked)} and len(got) == 40


def test_samples_are_bounded_in_bytes_and_lines(spark, monkeypatch):
    rows = [(k, "the thing and that " * 5, "en") for k in range(40)] + [(100, "der und " * 4000, "de"), (103, "nicht der und", "de")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language_id.learn(table).langs == ["de", "en"]
    texts = table.withColumn("rank", F.lit(1))
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(language_id, "LONGEST", 500)
    left = language_id._within_bytes(texts).collect()
    assert 900 < sum(len(r["text"]) for r in left) <= 1000 and 100 not in {r["doc_id"] for r in left}
    grams = spark.createDataFrame([("en", 1, 9), ("de", 1, 1), ("en", 2, 4), ("en", 3, 4), ("de", 4, 1)], language_id._GRAMS)
    for cells, want in ((8, {1, 2, 3, 4}), (7, {1, 2, 3}), (5, {1}), (1, set())):
        monkeypatch.setattr(language_id, "CELLS", cells)
        assert {r["gram"] for r in language_id._within_cells(grams).collect()} == want
    monkeypatch.setattr(quality_crf, "SAMPLE_LINES", 30)
    monkeypatch.setattr(quality_crf, "MOST_LINES", 10)
    lined = spark.createDataFrame([(k, "a\nb\nc") for k in range(50)] + [(60, "x\n" * 10), (61, None)], "doc_id bigint, text string")
    left = quality_crf._within_lines(lined).collect()
    assert 60 not in {r["doc_id"] for r in left} and 9 <= len(left) <= 11


def test_quality_sample_is_of_documents_at_hand(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "SAMPLE", 40)
    rows = [(k * 100, cases.prose(k, 60) if k % 2 else "BUY!!! NOW $$$ 100%\n" * 12) for k in range(60)]
    labels = [(k, int(k // 100 % 2)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = quality_crf.learn(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    score = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, model).collect()}
    assert model and all((score[k * 100] > 0.5) == bool(k % 2) for k in range(60))


def test_chat_log_is_folded_back(spark):
    """Deltas, regenerations and edits give the turns again, also equal, null and long ones."""
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "é<|end|>x" * rng.randrange(200), "same"]))
            for c in range(6) for t in (0, 0, 1, 2, None)]
    rows += [(3, 1, "assistant", "twice " * 90)] * 3 + [(None, 0, "assistant", "x")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    log = chat.event_log(table)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {None, "delta", "edit", "regenerate"}
    plain = chat.digest(chat.format_chats(table)).collect()
    folded = chat.digest(chat.format_chats(log.repartition(5), seq="seq", kind="kind")).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, folded))


def test_chat_long_turns_and_many_deltas(spark):
    """Time and memory follow the text: ten million characters, and two hundred thousand deltas."""
    text = "a<b[c|d\\\\" * 1_200_000
    formatted, _ = chat.render([("user", text), ("assistant", "ok")])
    tracemalloc.start()
    assert chat.read_back(formatted) == [("user", text), ("assistant", "ok")]
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    messages, began = [], time.monotonic()
    for _ in range(200_000):
        chat.fold(messages, "delta", "assistant", "word ")
    assert len("".join(messages[0][1])) == 1_000_000 and time.monotonic() - began < 2


def test_mix_has_its_slots(spark):
    """The first slot is the schedule's, and rows without an id are spread over parts."""
    rows = [(None if k % 2 else k, f"w{k} " * (k % 700), "abc"[k % 3]) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sized, mixed = mixing.mix(table, slot_words=64)
    assert sized.where("doc_id IS NULL").select("part").distinct().count() > 100
    firsts = {}
    for r in mixed.collect():
        key = (r["source"], r["part"], r["place"])
        firsts[key] = min(firsts.get(key, r["position"]), r["position"])
    got = mixing.taken(table, slot_words=64).collect()
    assert sorted(r["first_slot"] for r in got if r["first_slot"] is not None) == sorted(firsts.values())
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in got)
