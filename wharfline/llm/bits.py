"""Bitmaps of bounded size that tell tasks which keys may matter, put together by Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def bit_table(bits: DataFrame, size: int) -> np.ndarray:
    """``size`` bits as words of 64, those in the column ``bit`` set; what the driver gets is bounded by ``size`` / 64 rows."""
    words = bits.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, int(bit & 63))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(-(-size // 64), dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.view(np.uint64)


def bits_set(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    bit = bit.astype(np.uint64)
    return ((table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


class IdFilter:
    """Which ids may be in a set: no false negatives, about one in eight false positives until MOST_BITS are full."""

    def __init__(self, ids: DataFrame, column: str):
        wanted = 8 * ids.count()
        size = min(max(LEAST_BITS, 1 << max(0, wanted - 1).bit_length()), MOST_BITS)
        self.size = size - 1  # odd, so that ids in steps of a power of two spread
        self.table = bit_table(ids.select(F.pmod(F.col(column), F.lit(self.size).cast("long")).alias("bit")), size)

    def test(self, ids: np.ndarray) -> np.ndarray:
        return bits_set(self.table, np.mod(ids, self.size))
