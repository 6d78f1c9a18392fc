"""A bitmap of 64-bit hashes with a fixed greatest size: a first sieve for scans, never the last word.

It is built by aggregation and broadcast; at most 2^MOST_BITS bits (16 MB at 27) whatever the number of hashes. A fuller
bitmap lets more rows pass and so costs time; results don't change, as every use checks what passed against exact keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 27
LEAST_BITS = 16


class Bitmap:
    def __init__(self, bits: int, data: np.ndarray) -> None:
        self.mask, self.data = np.uint64((1 << bits) - 1), data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.data[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bitmap_of(df: DataFrame, hashes: Column, rows: int) -> Bitmap:
    """The bitmap of a bigint column of hashes by their last bits (a least hash has few free first bits), with about 64 bits a row."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * max(rows, 1)).bit_length()))
    at = hashes.bitwiseAND((1 << bits) - 1)
    one = F.lit(1).cast("bigint")
    words = df.select(F.shiftright(at, 6).cast("int").alias("w"), F.call_function("shiftleft", one, at.bitwiseAND(63).cast("int")).alias("b"))
    data = np.zeros(1 << (bits - 6), np.uint64)
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    data[table["w"].to_numpy()] = table["b"].to_numpy().view(np.uint64)
    return Bitmap(bits, data)
