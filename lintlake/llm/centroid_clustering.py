"""Clusters around centroids, with lower bounds loosened by planar geometry.

A vector keeps its cluster without being compared with the other centroids as long as it is
nearer to its own than a lower bound of its distance to all others says. When centroid p moves
to q, such a bound has to fall by |x-p| - |x-q|. Bounds are usually loosened by the whole drift
|q-p|. Here all vectors of a cluster lie in a sphere, and with m halfway between p and q

    |x-p| - |x-q| = 2 |q-p| t / (|x-p| + |x-q|) <= |q-p| t / |x-m|,

t being how far x lies beyond m in the direction of the move, as |x-p| + |x-q| >= 2 |x-m|. The
last fraction is the cosine of an angle at m, in the plane of x, p and q. Its largest value over
the sphere follows from the angle of the sphere's centre and the angle that its radius spans. It
is one only where the sphere holds m or lies straight ahead, and a centroid that moves away from
the whole sphere loosens nothing. Vectors that the bounds leave open are compared with all
centroids, in whole numbers.

Vectors are read where they lie and nothing but sums by cluster is shuffled: a row for each
cluster and component from a task. What a round has decided is stored beside the vectors, so
that a lost executor costs its own tasks only; the round before is then removed. The driver holds
the centroids.

Rows without exactly `WIDTH` components, or with null, NaN or infinite ones, are left out. Repeated rows count
as often as they occur and come out equal. Ids may be null or repeat; among the starting
centroids a null id counts as an empty one, and equal ids go by their components. Fewer rows
than centroids give fewer centroids; an empty table gives an empty result. Components beyond
`LIMIT` after scaling count as the limit, so that every squared distance is a long. Sums of
distances that exceed a long are null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import vectors
from lintlake.sources.store import keep, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
SEED = "2:"
#: Largest scaled component: 64 squares of differences stay below 2 ** 63.
LIMIT = 1 << 27
#: Up to this magnitude sums of 64 products are exact as doubles.
_EXACT = 1 << 22
#: Bounds are compared with this relative margin, far above the error of a distance.
_MARGIN = 1e-9

_STATE = "vec_id bigint, x array<int>, cluster int, distance bigint, lower double"


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors from all centroids."""
    kind = np.float64
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > _EXACT:
        kind = np.int64
    x, centroids = x.astype(kind), centroids.astype(kind)
    apart = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :]
    return (apart - 2 * (x @ centroids.T)).astype(np.int64)


def own_squared(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """The exact squared distance of each vector from its own centroid."""
    apart = x.astype(np.int64) - centroids[cluster]
    return (apart * apart).sum(axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the lower bounds of each cluster's vectors fall.

    They lie within `radius` of the cluster's old centroid; the bound is on the distance from
    all other centroids, which move from `old` to `new`.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    drift = np.linalg.norm(new - old, axis=1)
    ahead = (new - old) / np.where(drift > 0, drift, 1)[:, None]
    fall = np.zeros(len(old))
    for own, centre in enumerate(old):
        from_middle = centre - (old + new) / 2
        far = np.linalg.norm(from_middle, axis=1)
        outside = far > radius[own]
        apart = np.where(outside, far, 1)
        towards = np.arccos(np.clip((from_middle * ahead).sum(axis=1) / apart, -1, 1))
        spanned = np.arcsin(np.clip(radius[own] / apart, 0, 1))
        share = np.where(outside, np.cos(np.maximum(towards - spanned, 0)), 1)
        falls = drift * np.maximum(share, 0)
        falls[own] = 0
        fall[own] = falls.max()
    return fall * (1 + _MARGIN)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid from the nearest other one."""
    gaps = np.sqrt(squared(centroids, centroids).astype(np.float64))
    np.fill_diagonal(gaps, np.inf)
    return gaps.min(axis=1, initial=np.inf) / 2


def _scanned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, the second distance."""
    apart = squared(x, centroids)
    cluster = apart.argmin(axis=1)
    rows = np.arange(len(x))
    distance = apart[rows, cluster]
    if apart.shape[1] == 1:
        return cluster, distance, np.full(len(x), np.inf)
    apart[rows, cluster] = np.iinfo(np.int64).max
    return cluster, distance, np.sqrt(apart.min(axis=1).astype(np.float64))


def _assigned(centroids: np.ndarray, fall: np.ndarray | None):
    """Assigns vectors anew; `fall` is None where there is no earlier assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = half_gaps(centroids)
        for batch in batches:
            x = vectors.matrix(batch.column("x"), WIDTH)
            if fall is None:
                cluster, distance, lower = _scanned(x, centroids)
            else:
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                lower = batch.column("lower").to_numpy() - fall[cluster]
                distance = own_squared(x, centroids, cluster)
                safe = np.maximum(lower, gaps[cluster]) * (1 - _MARGIN)
                open_ = np.flatnonzero(~(np.sqrt(distance.astype(np.float64)) < safe))
                if len(open_):
                    cluster[open_], distance[open_], second = _scanned(x[open_], centroids)
                    lower = lower.copy()
                    lower[open_] = second
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)),
                 pa.array(distance), pa.array(lower)],
                names=["vec_id", "x", "cluster", "distance", "lower"],
            )

    return run


def _summed(clusters: int):
    """Of a task's vectors: by cluster, the largest distance and the count before the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, far = np.zeros((clusters, WIDTH + 1), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            x = vectors.matrix(batch.column("x"), WIDTH).astype(np.int64)
            order = np.argsort(cluster, kind="stable")
            found, begins = np.unique(cluster[order], return_index=True)
            if len(found):
                sums[found, 0] += np.diff(np.append(begins, len(cluster)))
                sums[found, 1:] += np.add.reduceat(x[order], begins, axis=0)
                np.maximum.at(far, cluster, batch.column("distance").to_numpy())
        some = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(far[some]),
             pa.array(list(sums[some]), pa.list_(pa.int64()))],
            names=["cluster", "far", "sums"],
        )

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next centroids, and how far the vectors of each cluster lie from the present ones."""
    parts = state.select("cluster", "distance", "x").mapInArrow(
        _summed(len(centroids)), "cluster int, far bigint, sums array<bigint>"
    )
    totals = (
        parts.select("cluster", "far", F.posexplode("sums").alias("place", "sum"))
        .groupBy("cluster", "place")
        .agg(F.sum("sum").alias("sum"), F.max("far").alias("far"))
        .toArrow()  # at most a row for each cluster and component
    )
    cluster, place = (totals[c].to_numpy().astype(np.int64) for c in ("cluster", "place"))
    sums, far = np.zeros((len(centroids), WIDTH + 1), np.int64), np.zeros(len(centroids))
    sums[cluster, place] = totals["sum"].to_numpy()
    far[cluster] = totals["far"].to_numpy()
    count = np.maximum(sums[:, :1], 1)
    return np.where(sums[:, :1] > 0, sums[:, 1:] // count, centroids), np.sqrt(far)


def numbered(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that are clustered, as vec_id and x."""
    kept = table.where(vectors.complete(F.col(vector)) & (F.size(vector) == WIDTH))
    return kept.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        vectors.scaled(F.col(vector), SCALE, LIMIT).alias("x"),
    )


def starting(rows: DataFrame) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    named = F.concat(F.lit(SEED), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = rows.select(F.sha2(named, 256).alias("hash"), "x").orderBy("hash", "x").limit(CLUSTERS)
    return np.array([row["x"] for row in first.collect()], np.int64).reshape(-1, WIDTH)


def assign(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The stored last assignment (vec_id, x, cluster, distance, lower) and its centroids."""
    rows = numbered(table, vec_id, vector)
    centroids = starting(rows)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], _STATE), centroids
    state = keep(rows.mapInArrow(_assigned(centroids, None), _STATE))
    for _ in range(ROUNDS):
        moved, radius = _moved(state, centroids)
        fall = loosening(centroids, moved, radius)
        following = keep(state.mapInArrow(_assigned(moved, fall), _STATE))
        release(state)
        state, centroids = following, moved
    return state, centroids


def cluster(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = table.sparkSession
    state, centroids = assign(table, vec_id, vector)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = state.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    inertias = {row["cluster"]: row["cluster_inertia"] for row in inertia.collect()}  # a row per cluster
    whole = None if None in inertias.values() else sum(inertias.values())
    whole = whole if whole is not None and whole < 1 << 63 else None
    about = [(k, inertias[k], whole, digests[k]) for k in inertias]
    names = "number int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    clusters = spark.createDataFrame(about, names)
    found = state.join(F.broadcast(clusters), state["cluster"] == clusters["number"])
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql() -> str:
    """The same for DuckDB: every vector against every centroid in each round."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x,
         sha256('{SEED}' || vec_id) AS h
  FROM embeddings
  WHERE len(embedding) = {WIDTH}
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM v ORDER BY h, x LIMIT {CLUSTERS})"""]
    for at in range(ROUNDS + 1):
        parts.append(f"""a{at} AS MATERIALIZED (
  SELECT r, unnest(min({{'d': d, 'k': k}})) FROM (
    SELECT r, k,
           list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM v, c{at}) GROUP BY r)""")
        if at < ROUNDS:
            parts.append(f"""c{at + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.c, old.c) AS c FROM c{at} AS old LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT k, i, sum(x[i])::BIGINT AS s, count(*) AS n
      FROM a{at} JOIN v USING (r), (SELECT unnest(range(1, {WIDTH + 1})) AS i) GROUP BY k, i)
    GROUP BY k) AS m USING (k))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, k::INT AS cluster, d AS distance,
       (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (k)"""
