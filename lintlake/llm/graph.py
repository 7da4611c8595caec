"""Connected components of a graph too large for one machine: distributed union-find."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.sources.store import keep, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EDGES = "u bigint, v bigint"


class Union:
    """Union-find over any keys; the least key is the root."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


#: Edges that are joined at a time.
_CHUNK = 100_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, some at a time, as links to the least key their nodes reach: (nodes, roots)."""
    nodes, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low in range(0, len(u), _CHUNK):
        union = Union()
        for a, b in zip(u[low : low + _CHUNK].tolist(), v[low : low + _CHUNK].tolist()):
            union.join(a, b)
        nodes.append(np.fromiter(union.parent, np.int64, len(union.parent)))
        roots.append(np.fromiter((union.find(x) for x in nodes[-1].tolist()), np.int64, len(nodes[-1])))
    return np.concatenate(nodes), np.concatenate(roots)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as links to the least key their nodes reach."""

    def links() -> pa.RecordBatch:
        joined = forest(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(column) for column in joined], names=["u", "v"])

    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += len(batch)
        if total >= _CHUNK:
            yield links()
            held, total = [], 0
    if total:
        yield links()


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours, linked to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself, linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, joined: bool = False) -> DataFrame:
    """(node, root) of every node that has an edge and is not itself the least of its component.

    `edges` has two bigint columns in any order, repeated or not. Each task first joins the
    edges of its batches on its own, unless the Python that made them has done so (`joined`, by
    `forest`): a second Python step in a stage would be a second worker beside every core. Then rounds of linking neighbours to the least one, which
    gather nothing, until the links stay the same. A node with very many edges is met with sums
    before the shuffle and joins that can be split.
    """
    u, v = (F.col(c) for c in edges.columns)
    ordered = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v")
    links = keep((ordered if joined else ordered.mapInArrow(_forest, _EDGES)).distinct())
    mark = None
    while True:
        count, sign = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if count == 0 or (count, sign) == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = count, sign
        before, links = links, keep(_smaller_to_least(_larger_to_least(links)))
        release(before)
