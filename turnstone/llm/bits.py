"""A filter of fixed size, small enough to be sent to all tasks whatever it is made of."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bits:
    """A map of fixed size, true at every hash (column x, a long) modulo its bits: a filter that lets some others pass."""

    def __init__(self, hashed: DataFrame, bits: int):
        words = hashed.select(F.pmod("x", F.lit(bits)).alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
        found = np.zeros(bits // 64, np.int64)
        rows = words.toArrow()  # at most bits / 64 rows
        found[rows["w"].to_numpy()] = rows["bits"].to_numpy()
        self.packed = found.view(np.uint8)

    def __getitem__(self, x: np.ndarray) -> np.ndarray:
        return (self.packed[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
