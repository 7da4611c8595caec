"""Clustering and whitening of vectors against plain versions over all vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from lintlake.llm import centroid_clustering, whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, cluster double"


def vector_rows(width=64):
    """(vec_id, embedding, two clashing names): groups, ties, repeats, nulls, infinities, lengths."""
    rng = random.Random(3)
    centres = [[rng.uniform(-2, 2) for _ in range(width)] for _ in range(12)]
    rows = [
        (k, [c + rng.gauss(0, 0.2) for c in centres[k % 12]], "x", 1.0) for k in range(400)
    ]
    rows += [(500, [0.5] * width, None, None)] * 150  # one group with a quarter of all rows
    rows += [(7, rows[7][1], "again", 0.0), (7, rows[8][1], "other", 0.0), (None, rows[9][1], None, None)]
    bad = [None, [], [0.1] * (width - 1), [0.1] * (width + 1)]
    bad += [[value] + [0.1] * (width - 1) for value in (None, math.nan, math.inf, -math.inf)]
    return rows + [(900 + k, vector, "bad", None) for k, vector in enumerate(bad)]


def usable(rows, width=64):
    return [
        (vec_id, np.array(v, np.float32).astype(np.float64))
        for vec_id, v, *_ in rows
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)
    ]


def brute_clusters(rows):
    kept = [(vec_id, np.floor(v * 256).astype(int)) for vec_id, v in usable(rows)]
    named = lambda vec_id: hashlib.sha256(f"2:{'' if vec_id is None else vec_id}".encode()).hexdigest()
    first = sorted(kept, key=lambda row: (named(row[0]), row[1].tolist()))[:40]
    centroids = [c for _, c in first]
    for at in range(6):
        found = []
        for _, x in kept:
            apart = [int(((x - c) ** 2).sum()) for c in centroids]
            found.append((apart.index(min(apart)), min(apart)))
        if at < 5:
            for k in range(len(centroids)):
                own = [x for (_, x), (cluster, _) in zip(kept, found) if cluster == k]
                if own:
                    centroids[k] = sum(own) // len(own)
    inertia = [sum(d for k, d in found if k == own) for own in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return sorted(
        (-1 if vec_id is None else vec_id, k, d, inertia[k], sum(inertia), digest[k])
        for (vec_id, _), (k, d) in zip(kept, found)
    )


@pytest.mark.parametrize("wanted", [slice(None), slice(0, 3), slice(0, 1)])
def test_clusters(spark, wanted):
    rows = vector_rows()[wanted]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = centroid_clustering.cluster(table)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == brute_clusters(rows)


def test_no_vectors(spark):
    table = spark.createDataFrame(vector_rows()[-8:], SCHEMA)
    for rows in (table, table.limit(0)):
        assert centroid_clustering.cluster(rows).count() == 0
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id NOT IN (902, 903)")).count() == 0


def test_far_vectors(spark):
    """Components beyond the limit count as the limit; no distance overflows."""
    rows = [(k, [s * 1e30] + [float(k)] * 63, "", 0.0) for k, s in enumerate((1, -1, 1, -1))]
    got = centroid_clustering.cluster(spark.createDataFrame(rows * 30, SCHEMA)).collect()
    assert len(got) == 120 and all(r["distance"] == 0 for r in got)


def test_loosening_is_safe_and_less_than_the_drift():
    rng = np.random.default_rng(5)
    less = 0
    for trial in range(200):
        old = rng.normal(0, 300, (6, 8))
        new = old + rng.normal(0, rng.choice([1, 30, 300]), old.shape)
        radius = rng.uniform(0, 400, 6)
        fall = centroid_clustering.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        for own in range(6):
            others = np.arange(6) != own
            ways = rng.normal(size=(300, 8))
            points = old[own] + ways / np.linalg.norm(ways, axis=1)[:, None] * radius[own]
            before = np.linalg.norm(points[:, None] - old[others], axis=2).min(axis=1)
            after = np.linalg.norm(points[:, None] - new[others], axis=2).min(axis=1)
            assert (before - after).max() <= fall[own] + 1e-9
            assert fall[own] <= drift[others].max() * (1 + 1e-6)
            less += fall[own] < drift[others].max() * 0.9
    assert less > 300


def test_most_vectors_are_not_scanned(spark, monkeypatch):
    """The bounds settle most vectors of well parted groups after the first rounds."""
    rows = [(vec_id, v.tolist(), "", 0.0) for vec_id, v in usable(vector_rows())]
    x = np.floor(np.array([v for _, v, *_ in rows]) * 256).astype(np.int64)
    centroids = x[:12]
    cluster, distance, lower = centroid_clustering._scanned(x, centroids)
    radius = np.array([math.sqrt(distance[cluster == k].max(initial=0)) for k in range(12)])
    moved = np.array([x[cluster == k].sum(axis=0) // (cluster == k).sum() for k in range(12)])
    safe = lower - centroid_clustering.loosening(centroids, moved, radius)[cluster]
    own = np.sqrt(centroid_clustering.own_squared(x, moved, cluster))
    again, _, second = centroid_clustering._scanned(x, moved)
    assert (safe <= second + 1e-9).all() and (again[own < safe] == cluster[own < safe]).all()
    assert (own < safe).mean() > 0.5


def test_decompose():
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    for values in (
        np.geomspace(1e6, 1e-6, 30), np.ones(30), np.repeat([5.0, 2.0, 1.0], 10), np.zeros(30),
        np.concatenate([[1e9], np.ones(29)]), np.linspace(1, 1 + 1e-9, 30),
    ):
        a = basis * values @ basis.T
        a = (a + a.T) / 2
        found, rows = whitening.decompose(a)
        size = max(np.abs(values).max(), 1e-300)
        assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-12 * size
        assert np.abs(rows @ rows.T - np.eye(30)).max() < 1e-13
        assert np.abs(rows @ a @ rows.T - np.diag(found)).max() <= 1e-12 * size


def test_polar():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - vectors * np.sign(values) @ vectors.T).max() < 1e-12


@pytest.mark.parametrize("width", [64, 6])
def test_whitening(spark, width):
    rows = vector_rows(width)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = usable(rows, width)
    x = np.array([np.floor(v * 64) + 1_000_000 for _, v in kept])
    shown = min(width, 32)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1][:shown], vectors.T[::-1][:shown]
    got = whitening.whiten(table).collect()
    assert len(got) == len(kept) * shown and {r["n"] for r in got} == {len(kept)}
    assert max(r["identity_error"] for r in got) < 1e-9
    exact = [[int(c) for c in row] for row in x]
    sums = [sum(column) for column in zip(*exact)]
    want = sorted(
        sum((len(kept) * c - s) ** 2 for c, s in zip(row, sums)) for row in exact for _ in range(shown)
    )
    assert sorted(r["deviation"] for r in got) == want
    made = np.array(sorted(abs(r["whitened"]) for r in got if r["component"] == 1))
    plain = np.sort(np.abs((x - x.mean(axis=0)) @ vectors[0]) / math.sqrt(values[0]))
    assert np.abs(made - plain).max() < 1e-8
    explained = {r["component"]: r["explained"] for r in got}
    trace = np.trace(np.cov(x.T, bias=True))
    assert all(abs(explained[k + 1] - values[k] / trace) < 1e-12 for k in range(shown))


def test_whitening_of_hard_rows(spark):
    """One vector has no variance; two have one direction; another length is left out; a
    deviation beyond a long is null."""
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["explained"]) for r in one] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [9.0]), (3, None)]
    two = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["component"]) for r in two) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert sorted(abs(round(r["whitened"], 9)) for r in two) == [0, 0, 1, 1]
    far = [(k, [(-1.0) ** k * 1e300, 0.0]) for k in range(8)]
    got = whitening.whiten(spark.createDataFrame(far, "vec_id bigint, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} and len(got) == 16
