"""Line and document deduplication and decontamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintlake.llm import decontaminate, graph, jaccard_join, line_dedup, signature_tree, tokens
from tests.llm import cases


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1600)]
    edges += [(k, k + 1) for k in range(5000, 5400)] + [(9000, k) for k in range(9001, 9500)] + [(1, 1)]
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {n: r for n, r in reach({x for e in edges for x in e}, edges).items() if n != r}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_copies(count, words, seed):
    """Copies of one text with changes, from very near to far."""
    rng, base = random.Random(seed), cases.prose(seed, words).split()
    texts = []
    for k in range(count):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"other{rng.randrange(1000)}"
        texts.append(" ".join(own))
    return texts


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    roots = reach(range(len(rows)), links)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[roots[i]] = min(least.get(roots[i], doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[roots[i]]) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 900, 100])
def test_jaccard_join(spark, block):
    texts = near_copies(60, 60, 7) + near_copies(25, 30, 8) + near_copies(8, 500, 9)
    texts += [cases.prose(k, 40) for k in range(30)] + ["Word", "word", None, "", "a b", "A  B", "x " * 300] * 2
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.join(table, block=block).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_jaccard_join_with_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_COMMON", 100)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    texts = near_copies(150, 40, 3) + [cases.prose(k, 40) for k in range(10)]
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    total = sum(len(shingle_set(t)) for t in texts)
    classes = table.select("doc_id", F.lit(0).cast("bigint").alias("tag"), "text").mapInArrow(
        jaccard_join._document_classes(5), jaccard_join._CLASSES)
    assert len(jaccard_join._common_tokens(classes, total)[0]) > 0
    got = jaccard_join.join(table).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_first_of_each(docs, none):
    first = jaccard_join.first_of_each(docs)
    assert first.columns == docs.columns
    ids = sorted((r["doc_id"] or -1) for r in first.collect())
    assert ids == [-1, 1, 4, 5, 6, 7, 9, 10, 12, 13, 14, 15, 16, 17, 18, 19, 19]
    assert jaccard_join.first_of_each(none).count() == 0 and jaccard_join.join(none).count() == 0


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute_hits(text, items):
    own, hit, ids = words(text), set(), set()
    for item, other in items:
        theirs = words(other)
        n = min(len(theirs), 10)
        grams = {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)} if n else set()
        for k in range(len(own) - n + 1):
            if n and tuple(own[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                ids.add(str(item))
    return len(own), len(hit), sorted(ids)


def test_decontamination(spark, docs, none):
    items = [(k, cases.prose(100 + k, 30)) for k in range(12)]
    items += [(50, "Just FIVE words, of it"), (51, "zero"), (52, None), (53, "..."), (2, items[2][1]), (60, "日本語")]
    rng, texts = random.Random(2), []
    for k in range(40):
        item = items[rng.randrange(12)][1].split()
        a, n = rng.randrange(20), rng.randrange(5, 16)
        texts.append(f"{cases.prose(k, 15)} {' '.join(item[a : a + n]).upper()}; {cases.prose(900 + k, 9)} just, five words of IT")
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "Zero"), (5, "zero zero one"), (None, texts[0]), (7, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((repr(r["doc_id"]), *map(repr, brute_hits(r["text"], items))) for r in table.collect())
    got = decontaminate.report(table, bench).collect()
    assert sorted((repr(r["doc_id"]), repr(r["n_words"]), repr(r["n_hit"]), repr(r["items"])) for r in got) == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r["row"] for r in clean.collect()} == {r["row"] for r in docs.collect() if not brute_hits(r["text"], items)[1]}
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.clean_documents(none, bench).count() == 0


def test_winnowing():
    """Each place once, and every shared window of ten words holds a shared fingerprint."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(60))) for _ in range(40)]
    shared = [cases.prose(77, 14), "a a a a a a a a a a a a"]
    texts += [f"{cases.prose(k, 9)} {shared[k % 2]} {cases.prose(k + 50, 9)}" for k in range(8)]
    hashes, bounds = tokens.words(*tokens.text_bytes(pa.array(texts)), tokens.letters_and_digits())
    at, parts = decontaminate.chosen(hashes, bounds)
    assert len(set(at.tolist())) == len(at)
    own = [words(t) for t in texts]
    prints = [set(parts[at[(at >= a) & (at < b)]].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    inside = lambda k, n: {tuple(own[k][i : i + n]) for i in range(len(own[k]) - n + 1)}
    met = 0
    for k in range(len(texts)):
        # Fewer than a half of all k-grams are kept.
        assert len(own[k]) < 30 or len(at[(at >= bounds[k]) & (at < bounds[k + 1])]) < 0.6 * len(own[k])
        for j in range(k):
            if inside(k, 10) & inside(j, 10):
                met += 1
                assert prints[k] & prints[j]
    assert met > 10


def test_decontamination_joins_on_the_fingerprint_alone(spark):
    """A shared k-gram that extends to nine words is no hit, to ten is one."""
    item = cases.prose(5, 40).split()
    other = cases.prose(6, 40).split()
    texts = [" ".join([*other[:5], *item[8 : 8 + n], *other[9:20]]) for n in range(5, 26)]
    docs = spark.createDataFrame(list(enumerate(texts, 5)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[::-1])), (3, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == {n: (n, ["1", "3"]) if n >= 10 else (0, []) for n in range(5, 26)}


def line_set(line):
    data = line.encode()
    return {data[i : i + 8] for i in range(len(data) - 7)}


def brute_lines(rows):
    """Which (row, line) go: distinct (id, text) pairs are documents."""
    lines = []
    for doc_id, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for at, line in enumerate(text.split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if len(line.encode()) >= line_dedup.MIN_LINE:
                lines.append((doc_id, at, line))
    distinct = sorted({line for _, _, line in lines})
    sets = {line: line_set(line) for line in distinct}
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k]
             if sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = reach(distinct, links)
    first, lost = {}, set()
    for doc_id, at, line in lines:
        if first.setdefault(roots[line], (doc_id, at)) != (doc_id, at):
            lost.add((doc_id, at))
    return lost


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(cases.WORDS) + str(rng.randrange(90)) for _ in range(30)) for _ in range(25)]
    rows = []
    for k in range(80):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base)
            if rng.random() < 0.5:
                own = line.split()
                own[rng.randrange(len(own))] = f"new{rng.randrange(99)}"
                line = " ".join(own)
            lines.append(rng.choice(["", " ", "\t"]) + line + rng.choice(["", "\r"]))
        rows.append((k * 7 % 80, "\n".join([*lines, "short", cases.prose(500 + k, 12)])))
    return rows + [(200, None), (201, ""), (202, "\n\n"), (0, rows[0][1]), (203, "é" * 60), (None, base[0])]


def test_lines(spark, lined):
    table = spark.createDataFrame(lined, "doc_id bigint, text string")
    got = line_dedup.repeated_lines(table).collect()
    assert len(got) == len(lined)
    assert {(r["doc_id"], at) for r in got for at in r["removed"]} == brute_lines(lined)


def test_lines_are_cut_out(spark, lined):
    table = spark.createDataFrame([(d, t, "x", "y") for d, t in lined], "doc_id bigint, text string, tag string, removed string")
    left, lost = line_dedup.deduplicated(table), brute_lines(lined)
    assert left.columns == table.columns
    want = []
    for doc_id, text in lined:
        gone = {at for d, at in lost if d == doc_id}
        kept = [line for at, line in enumerate((text or "").split("\n")) if at not in gone]
        if not gone:
            want.append((doc_id, text))
        elif "".join(kept).strip():
            want.append((doc_id, "\n".join(kept)))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(repr, want))


def test_lines_cases(docs, none):
    left = line_dedup.deduplicated(docs)
    assert left.columns == docs.columns and left.where("doc_id = 15").first()["text"].count("\n") == 0
    assert line_dedup.deduplicated(none).count() == 0


def test_bands_find_what_is_similar():
    rng, found, n = random.Random(6), 0, 400
    for _ in range(n):
        line = [rng.choice(cases.WORDS) + str(rng.randrange(90)) for _ in range(60)]
        other = list(line)
        while True:
            other[rng.randrange(60)] = f"q{rng.randrange(999)}"
            a, b = line_set(" ".join(line)), line_set(" ".join(other))
            if len(a & b) / len(a | b) < 0.85:
                break
        bands = line_dedup.signatures([" ".join(line).encode(), " ".join(other).encode()])
        found += bool((bands[0] == bands[1]).any())
    assert found >= 0.97 * n


def test_short_lines_are_compared(spark):
    """Equal lines of any length are copies, near ones from a shingle's length on."""
    notice, other = "All rights reserved.", "Licensed under the CC BY-NC 4.0."
    rows = [
        (1, f"{notice}\nMIT\n日本\n\n{other}"), (2, f" {notice}\r\nGPL\n\nown words of two\n日本"),
        (3, f"MIT\nown words of three\nMIT\n{other[:-1]}"), (4, f"{notice}\n MIT"),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.repeated_lines(table).collect()}
    assert got == {1: (4, []), 2: (4, [0, 4]), 3: (4, [0, 2, 3]), 4: (2, [0, 1])}
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(table).collect()}
    assert left == {1: rows[0][1], 2: "GPL\n\nown words of two", 3: "own words of three"}


def test_connected_sets_are_not_compared_again(monkeypatch):
    """A large group of near copies costs about its size, not its square, and gives one component."""
    seen, possible = [], signature_tree._possible

    def counted(a, b, i, j, percent):
        seen.append(len(i) * len(j))
        return possible(a, b, i, j, percent)

    monkeypatch.setattr(signature_tree, "_possible", counted)
    rng, n = np.random.default_rng(3), 2000
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for _ in range(n):
        own = base.copy()
        own[rng.choice(200, 8, replace=False)] = rng.integers(0, 1 << 60, 8)
        sets.append(np.unique(own))
    sizes = np.array([len(s) for s in sets], np.int64)
    links = signature_tree.links(sizes, sets, np.zeros(n, np.int8), 75)
    assert len(links) == n - 1 and len(reach(range(n), links)) == n
    assert sum(seen) < n * n / 10


def test_tree_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    for n, two in [(1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (5, 0), (90, 0), (90, 1), (300, 0), (300, 1)]:
        bases = [rng.integers(0, 500, 30).astype(np.uint64) for _ in range(4)]
        sets = []
        for k in range(n):
            own = bases[k % 4].copy()
            change = rng.random(30) < 0.1
            own[change] = rng.integers(0, 1 << 60, change.sum())
            sets.append(np.unique(own))
        side = (np.arange(n) % 3 == 0).astype(np.int8) * two
        words = [set(s.tolist()) for s in sets]
        similar = [(p, q) for q in range(n) for p in range(q) if side[p] != side[q] or not two
                   if 100 * len(words[p] & words[q]) >= 75 * len(words[p] | words[q])]
        found = signature_tree.links(np.array([len(s) for s in sets], np.int64), sets, side, 75)
        assert reach(range(n), found) == reach(range(n), similar)


def test_texts_are_read_by_two_python_steps(spark, monkeypatch):
    """The lines' classes and the texts of candidates come from one pass."""
    stored, keep = [], line_dedup.keep

    def kept(table, *folder):
        plan = table._jdf.queryExecution().executedPlan().toString()
        stored.append(len(re.findall(r"MapInArrow (?:_line_classes|_grouped_texts|run)", plan)))
        return keep(table, *folder)

    monkeypatch.setattr(line_dedup, "keep", kept)
    table = spark.createDataFrame([(k, f"one line of many words {k}\n\nother") for k in range(9)], "doc_id bigint, text string")
    assert line_dedup.repeated_lines(table).where("size(removed) > 0").count() == 8
    assert sum(stored) == 1


def test_first_of_each_keeps_unrelated_texts_of_one_id(spark):
    copied, named = cases.prose(22, 50), cases.prose(23, 50)
    rows = [
        (19, cases.prose(20, 50), "a"), (19, cases.prose(21, 50), "b"), (None, copied, "c"), (None, copied, "c"),
        (None, cases.prose(24, 50), "d"), (None, named, "e"), (7, named, "f"), (3, named, "g"), (3, cases.prose(25, 50), "h"),
        (None, None, "i"), (None, None, "j"), (None, " ", "k"), (5, "", "l"), (5, "", "m"),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    left = jaccard_join.first_of_each(table)
    assert left.columns == table.columns
    assert sorted(r["mark"] for r in left.collect()) == list("abcdghijklm")


def test_a_stage_has_one_python_step(spark, monkeypatch):
    """A second one in a stage is a second Python worker beside every core, for the whole run."""
    stored = []

    def recording(module):
        keep = module.keep

        def kept(table, *folder):
            stored.append(table._jdf.queryExecution().executedPlan().toString())
            return keep(table, *folder)

        monkeypatch.setattr(module, "keep", kept)

    for module in (graph, jaccard_join, line_dedup):
        recording(module)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join([*words[:at], "x", *words[at + 1 :]]) for at in range(30)] * 2
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "doc_id bigint, text string")
    assert jaccard_join.join(docs, block=40).select("component_id").distinct().count() < 30
    assert line_dedup.repeated_lines(docs).where("size(removed) > 0").count() > 0
    for plan in stored:
        stages = plan.split("Exchange")
        assert all(len(re.findall(r"(?:Map|MapGroups)InArrow", stage)) < 2 for stage in stages), plan


def test_forest():
    u, v = graph.forest(np.array([5, 7, 9, 2], np.int64), np.array([3, 5, 8, 3], np.int64))
    assert dict(zip(u.tolist(), v.tolist())) == {5: 2, 7: 2, 9: 8, 3: 2}
    assert [len(column) for column in graph.forest(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]
