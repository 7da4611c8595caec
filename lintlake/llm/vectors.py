"""Vectors of whole numbers, made from columns of floats and read as numpy matrices."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# What runs on the executors travels with the job, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def complete(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers; false for null."""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, number), F.lit(False))


def scaled(vector: Column, factor: int, limit: int) -> Column:
    """floor(factor * component) of each component as a double; beyond the limit, the limit."""

    def whole(c: Column) -> Column:
        made = c.cast("double") * F.lit(float(factor))
        bounded = F.least(F.greatest(made, F.lit(float(-limit))), F.lit(float(limit)))
        return F.floor(bounded).cast("int")

    return F.transform(vector, whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
