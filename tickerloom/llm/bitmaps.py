"""Bitmaps of bounded size over 64-bit hashes, as hints to tasks.

A bit may be set by several hashes, so a bitmap names a superset: what it lets pass is always
settled exactly by what follows, and a full bitmap costs time and never a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each entry, and the least and the most bits, as powers of two: 16 MB at most.
SPARSE = 16
LEAST, MOST = 16, 27


def bitmap(hashes: DataFrame, sparse: int = SPARSE, most: int = MOST) -> np.ndarray:
    """The bitmap of the one BIGINT column of ``hashes``, as 64-bit words.

    It has ``sparse`` bits for each row, up to ``2 ** most`` bits. Bits are set by Spark; the driver gets the words that are not zero, a bounded number.
    """
    (column,) = hashes.columns
    wanted = max(1, hashes.count() * sparse)
    bits = min(max((wanted - 1).bit_length(), LEAST), most)
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        hashes.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("set"))
        .toArrow()
    )
    found = np.zeros(1 << (bits - 6), np.uint64)
    found[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return found


def among(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned ``hashes`` have their bit set."""
    slot = hashes & np.uint64(len(found) * 64 - 1)
    return (found[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
