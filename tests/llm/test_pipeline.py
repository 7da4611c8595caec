"""The pipeline's stages, each on its own input, against the brute-force versions."""

import inspect

import pytest

import corpus_pipeline
from lintlake.llm import quality_rules
from lintlake.sources.store import keep
from tests.llm.test_texts import brute_components, brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def rows(table):
    return [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def stages(spark):
    """What went into each stage and what came out."""
    docs, made = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, run in corpus_pipeline.STAGES:
        out = keep(run(spark, docs, SF))
        made.append((name, docs, out))
        docs = out
    return made


def test_order(stages):
    methods = [inspect.getsource(run) for _, run in corpus_pipeline.STAGES]
    for source, module in zip(methods, ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "mixing"]):
        assert module in source
    for _, docs, out in stages[:-1]:
        assert out.dtypes == docs.dtypes


def test_quality(stages):
    _, docs, out = stages[0]
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert {d for d, _ in rows(out)} == kept and set(rows(out)) <= set(rows(docs))


def test_lines(stages):
    _, docs, out = stages[1]
    lost, want = brute_lines(rows(docs)), {}
    for doc_id, text in rows(docs):
        kept = [line for at, line in enumerate(text.split("\n")) if (doc_id, at) not in lost]
        if "".join(kept).strip():
            want[doc_id] = "\n".join(kept)
    assert dict(rows(out)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_near_duplicates(stages):
    _, docs, out = stages[2]
    want = {component for _, _, component in brute_components(rows(docs))}
    assert {d for d, _ in rows(out)} == want and len(rows(out)) == len(want)


def test_benchmark(spark, stages):
    _, docs, out = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {d for d, _ in rows(out)} == {d for d, t in rows(docs) if not brute_hits(t, items)[1]}


def test_mix(stages):
    _, docs, out = stages[4]
    got = out.collect()
    assert len(got) == docs.count() and sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=20)


def test_run_is_the_stages(spark, stages):
    """Two runs, read after both: neither removes what the other's result reads."""
    first, second = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    want = sorted(map(repr, stages[-1][2].collect()))
    assert sorted(map(repr, second.collect())) == sorted(map(repr, first.collect())) == want


def test_cases(spark, docs, none):
    """The hard rows: what each stage keeps of them, other columns as they are."""
    made, kept = docs, []
    for name, run in corpus_pipeline.STAGES:
        made = keep(run(spark, made, SF))
        kept.append(made)
    rules, lined, near, clean, mixed = kept
    for table in kept[:-1]:
        assert table.dtypes == docs.dtypes
    judged = {r["row"] for r in quality_rules.kept_documents(docs).collect()}
    assert judged == {r["row"] for r in rules.collect()} and not rules.where("text IS NULL").count()
    # Rows of copies (ids 1, 2, 2, 3) leave one text; two texts of id 19 and that of no id stay.
    of = lambda table, where: table.where(where).count()
    assert of(rules, "doc_id IN (1, 2, 3)") == 4 and of(near, "doc_id IN (1, 2, 3)") == 1
    assert of(near, "doc_id = 19") == of(rules, "doc_id = 19") and of(near, "doc_id IS NULL") == of(rules, "doc_id IS NULL")
    assert {r["row"] for r in near.collect()} <= {r["row"] for r in lined.collect()} <= judged
    hit = {r["row"] for r in near.collect()} - {r["row"] for r in clean.collect()}
    assert not hit and sorted(r["doc_id"] or -1 for r in mixed.collect()) == sorted(r["doc_id"] or -1 for r in clean.collect())
    made = none
    for name, run in corpus_pipeline.STAGES:
        made = keep(run(spark, made, SF))
    assert made.count() == 0
