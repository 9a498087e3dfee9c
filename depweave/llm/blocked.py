"""Blocked Bloom filters that tasks probe with arrays of fingerprints.

A block is four longs, one bit of each is set for a fingerprint. Filters may be cut into shards, each with a power of
two of blocks; all of them together have at most ``most_blocks``, so what is broadcast is bounded. A crowded filter
lets more through, never less, and an exact step follows wherever a hit counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 4
#: Fingerprint bits below this name the block; so a shard has at most 2**24 blocks.
_FIRST = 24


@dataclass(frozen=True)
class Blocked:
    """``table``: blocks x lanes. Shard i has ``sizes[i]`` blocks from ``offsets[i]`` on."""

    table: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray

    def may_hold(self, keys: np.ndarray, shard: int | np.ndarray = 0) -> np.ndarray:
        """Which fingerprints (uint64) the shard may hold."""
        size = self.sizes[shard].astype(np.uint64)
        at = self.offsets[shard] + (keys & np.maximum(size, np.uint64(1)) - np.uint64(1)).astype(np.int64)
        found = np.broadcast_to(size > 0, keys.shape).copy()
        for lane in range(LANES):
            bit = keys >> np.uint64(_FIRST + 6 * lane) & np.uint64(63)
            found &= (self.table[at, lane] >> bit & np.uint64(1)).astype(bool)
        return found


def _sizes(counts: list[int], bits: int, most_blocks: int) -> list[int]:
    """A power of two of blocks for each count, all together at most ``most_blocks``."""
    out = [1 << max(0, (n * bits // (64 * LANES)).bit_length()) if n else 0 for n in counts]
    while sum(out) > most_blocks and max(out) > 1:
        out = [x // 2 if x == max(out) else x for x in out]
    return out


def blocked(keys: DataFrame, key: str, counts: list[int], shard: str | None = None, bits: int = 24, most_blocks: int = 1 << 18) -> Blocked:
    """The filter of a column of longs; ``counts`` has the number of keys of each shard (``shard``: a column with
    0, 1, ..). Its blocks are made in tasks, and at most ``most_blocks`` rows (2**18: 8 MB) come to the driver."""
    sizes = _sizes(counts, bits, most_blocks)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    table = np.zeros((max(1, int(offsets[-1])), LANES), np.uint64)

    def of_shard(values: list[int]) -> Column:
        if shard is None:
            return F.lit(int(values[0])).cast("long")
        return F.element_at(F.array(*(F.lit(int(x)).cast("long") for x in values)), F.col(shard).cast("int") + 1)

    def shifted(n: int) -> Column:
        return F.shiftrightunsigned(F.col(key), n).bitwiseAND(63).cast("int")

    block = of_shard(offsets[:-1].tolist()) + F.col(key).bitwiseAND(of_shard([max(x, 1) - 1 for x in sizes]))
    lanes = [F.call_function("shiftleft", F.lit(1).cast("long"), shifted(_FIRST + 6 * i)).alias(f"lane{i}") for i in range(LANES)]
    rows = keys.select(block.alias("block"), *lanes).groupBy("block").agg(*(F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)))
    found = rows.toArrow()
    at = found.column("block").to_numpy()
    for i in range(LANES):
        table[at, i] = found.column(f"lane{i}").to_numpy().view(np.uint64)
    return Blocked(table, offsets[:-1].astype(np.int64), np.array(sizes, np.int64))


def signed(keys: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers as the longs of the same bits."""
    return keys.view(np.int64)


def inverse(base: int) -> int:
    """What ``base`` (odd) gives 1 with, modulo 2**64."""
    return pow(base, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, .. modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def any_of(*columns: Column) -> Column:
    return reduce(Column.__or__, columns)
