"""Whitening of embeddings by spectral divide and conquer.

The covariance of all vectors is gathered in two passes of sums, first of components, then of
products around a whole number near the mean, which for ordinary data are exact. It is as large
as a vector is long, squared, and is taken apart on the driver:

* `polar` finds the orthogonal polar factor of the covariance less a shift, by dynamically
  weighted Halley iterations on QR decompositions (QDWH). Its eigenvalues are +1 and -1, for
  directions above and below the shift, so half of it plus the identity is a spectral projector.
* `decompose` takes bases of what the projector keeps and of the rest, both invariant under the
  covariance, and splits the two smaller matrices in the same way down to single components.

Every task then gets the components and whitens the vectors it reads. Nothing but sums is
shuffled, no vector is, and nothing is stored.

Rows whose vector is null, empty or holds nulls, NaN or infinities are left out. Vectors of
several lengths are not comparable: those of the most frequent length stay (ties: the longer).
Repeated rows count as often as they occur; ids may be null or repeat. Scaled components beyond
`LIMIT` count as the limit. A direction without variance (under 1e-13 of all) has whitened 0. A
deviation that exceeds a long is null. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMIT = 1 << 30
#: Longest vector; the driver gets a matrix of this size squared, 134 MB.
MAX_WIDTH = 4096
_EPS = np.finfo(np.float64).eps
#: Share of all variance below which a direction counts as having none.
_NONE = 1e-13


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH iterations.

    `low` is a lower bound of the smallest singular value of the scaled matrix; starting from
    the smallest that doubles tell apart, six iterations bring all of them to one.
    """
    size = len(a)
    x, low = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny), _EPS / 2
    for _ in range(12):
        square = low * low
        weight = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + weight)
        alpha = root + np.sqrt(8 - 4 * weight + 8 * (2 - square) / (square * root)) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(size)]))
        step = (alpha - beta / gamma) / np.sqrt(gamma) * (q[:size] @ q[size:].T)
        following = beta / gamma * x + step
        following = (following + following.T) / 2
        change, x = np.linalg.norm(following - x), following
        low = min(low * (alpha + beta * square) / (1 + gamma * square), 1.0)
        if 1 - low < 8 * _EPS and change < np.cbrt(8 * _EPS):
            break
    return x


def _projector(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """The projector on the directions above a shift, and their number.

    The mean of the eigenvalues has some on either side. A shift that meets an eigenvalue gives
    no projector and the next one is tried.
    """
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size)) / np.sqrt(size)
    for move in (0, 0.01, -0.01, 0.05, -0.05, 0.2, -0.2):
        made = (polar(a - (mean + move * spread) * np.eye(size)) + np.eye(size)) / 2
        above = int(round(np.trace(made)))
        if 0 < above < size and np.linalg.norm(made @ made - made) < 1e-8:
            return made, above
    return None


def _split(a: np.ndarray, enough: float, random: np.random.Generator) -> np.ndarray:
    """An orthonormal basis in which a symmetric matrix is diagonal."""
    size = len(a)
    if size == 1 or np.linalg.norm(a - np.diag(np.diag(a))) <= enough:
        return np.eye(size)
    found = _projector(a)
    if found is None:  # eigenvalues that no shift can part are equal to double precision
        return np.eye(size)
    projector, above = found
    basis = random.standard_normal((size, above))
    for _ in range(3):
        basis, _ = np.linalg.qr(projector @ basis)
    whole, _ = np.linalg.qr(basis, mode="complete")
    parts = []
    for part in (whole[:, :above], whole[:, above:]):
        inner = part.T @ a @ part
        parts.append(part @ _split((inner + inner.T) / 2, enough, random))
    return np.hstack(parts)


def decompose(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, the largest entry of each positive."""
    random = np.random.default_rng(13)
    basis = _split(covariance, 4 * _EPS * np.linalg.norm(covariance), random)
    # A second pass in the basis that was found takes away the rounding of the first.
    inner = basis.T @ covariance @ basis
    basis = np.linalg.qr(basis @ _split((inner + inner.T) / 2, 4 * _EPS * np.linalg.norm(covariance), random))[0]
    values = np.einsum("ij,ik,kj->j", basis, covariance, basis)
    order = np.argsort(-values, kind="stable")
    rows = basis.T[order]
    largest = np.abs(rows).argmax(axis=1)
    signs = np.where(rows[np.arange(len(rows)), largest] < 0, -1.0, 1.0)
    return values[order], rows * signs[:, None]


class Whitening:
    """What is broadcast: count and sums of the fit list, components and their variances."""

    def __init__(self, count: int, sums: np.ndarray, covariance: np.ndarray):
        self.count, self.sums = count, sums
        self.near = sums // max(count, 1)
        self.rest = (sums - self.near * count) / max(count, 1)
        values, rows = decompose(covariance)
        self.trace = float(np.trace(covariance))
        self.values, self.rows = values[:COMPONENTS], rows[:COMPONENTS]
        some = self.values > _NONE * self.trace
        scale = np.where(some, 1 / np.sqrt(np.where(some, self.values, 1)), 0)
        self.weights = self.rows * scale[:, None]
        self.explained = self.values / self.trace if self.trace else np.zeros(len(self.values))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Vectors, scaled and not yet shifted, on the components with unit variance."""
        return ((x - self.near).astype(np.float64) - self.rest) @ self.weights.T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact squared lengths of count * x - sums, None beyond a long."""
        apart = self.count * (x.astype(np.int64) - self.near) - (self.sums - self.near * self.count)
        if (apart.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum(c * c for c in row) for row in apart.tolist()]
        return [value if value < 1 << 63 else None for value in exact]


def _task_sums(width: int, of: Callable[[np.ndarray], np.ndarray]):
    """Per task, the sum of what `of` makes of its vectors, a row of numbers for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = of(vectors.matrix(batch.column("x"), width))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], names=["i", "sums"]
            )

    return run


def _gathered(rows: DataFrame, width: int, of, kind: str, shape: tuple[int, int]) -> np.ndarray:
    """The sums of all tasks: one matrix of a size that does not depend on the rows."""
    parts = rows.select("x").mapInArrow(_task_sums(width, of), f"i int, sums array<{kind}>")
    whole = (
        parts.select("i", F.posexplode("sums").alias("j", "sum"))
        .groupBy("i", "j")
        .agg(F.sum("sum").alias("sum"))
        .toArrow()
    )
    made = np.zeros(shape, np.int64 if kind == "bigint" else np.float64)
    made[whole["i"].to_numpy(), whole["j"].to_numpy()] = whole["sum"].to_numpy()
    return made


def numbered(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The fit list as vec_id and scaled, not yet shifted x, and the length of its vectors."""
    kept = table.where(vectors.complete(F.col(vector)) & (F.size(vector) > 0))
    lengths = kept.groupBy(F.size(vector).alias("width")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    width = first["width"] if first else 0
    if width > MAX_WIDTH:
        raise ValueError(f"vectors have {width} components, more than {MAX_WIDTH}")
    rows = kept.where(F.size(vector) == width).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        vectors.scaled(F.col(vector), SCALE, LIMIT).alias("x"),
    )
    return rows, width


def fit(rows: DataFrame, width: int) -> Whitening:
    """Count, mean, covariance and components of all rows."""

    def counted(x: np.ndarray) -> np.ndarray:
        sums = x.sum(axis=0, dtype=np.int64)
        return np.vstack([sums, np.full_like(sums, len(x))])

    sums, counts = _gathered(rows, width, counted, "bigint", (2, width))
    count = int(counts[0]) if width else 0
    near = sums // max(count, 1)

    def products(x: np.ndarray) -> np.ndarray:
        apart = (x - near).astype(np.float64)
        return apart.T @ apart

    mean = (sums - near * count) / max(count, 1)
    covariance = _gathered(rows, width, products, "double", (width, width)) / max(count, 1)
    covariance = (covariance + covariance.T) / 2 - np.outer(mean, mean)
    return Whitening(count, sums, covariance)


def identity_error(rows: DataFrame, width: int, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    shown = len(model.values)

    def products(x: np.ndarray) -> np.ndarray:
        made = model.whitened(x)
        return np.vstack([made.T @ made, made.sum(axis=0)])

    sums = _gathered(rows, width, products, "double", (shown + 1, shown)) / max(model.count, 1)
    covariance = sums[:shown] - np.outer(sums[shown], sums[shown])
    return float(np.abs(covariance - np.eye(shown)).max(initial=0.0))


_WHITE = "vec_id bigint, deviation bigint, whitened array<double>"


def _whitened(model: Whitening, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column("x"), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(model.deviations(x), pa.int64()),
                 pa.array(list(model.whitened(x)), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"],
            )

    return run


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each
    vector and component."""
    rows, width = numbered(table, vec_id, vector)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not width:
        layout = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], layout)
    model = fit(rows, width)
    error = identity_error(rows, width, model)
    made = rows.mapInArrow(_whitened(model, width), _WHITE)
    explained = F.array(*[F.lit(float(value)) for value in model.explained])
    return made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.count).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    ).select(names)
