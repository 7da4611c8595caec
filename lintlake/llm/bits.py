"""A table of bits for a set of 64-bit keys: of fixed size, it may say yes to other keys."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Size of a table, which goes to every executor, as a power of two: four megabytes.
BITS = 25


def table(keys: DataFrame) -> np.ndarray:
    """Two bits set for each key in the one bigint column. The driver gets the table only, in
    at most 2 ** (BITS - 6) words, however many keys there are."""
    key, mask = F.col(keys.columns[0]), (1 << BITS) - 1
    places = F.array(key.bitwiseAND(mask), F.shiftrightunsigned(key, BITS).bitwiseAND(mask))
    words = (
        keys.select(F.explode(places).alias("bit"))
        .select(F.shiftright("bit", 6).alias("word"), (F.col("bit") % 64).cast("int").alias("at"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, at))").alias("set"))
        .toArrow()
    )
    made = np.zeros(1 << (BITS - 6), np.uint64)
    made[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return made


def passes(made: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the table may hold."""
    mask, place = np.uint64((1 << BITS) - 1), np.uint64(63)
    found = np.ones(len(keys), np.uint64)
    for bit in (keys & mask, (keys >> np.uint64(BITS)) & mask):
        found &= (made[bit >> np.uint64(6)] >> (bit & place)) & np.uint64(1)
    return found.astype(bool)
