"""Blocked Bloom filters as small tables: an early, map-side answer to "may this key be among those?".

A block is four longs, one bit of each is set for a key, and all bits of a key are in one block. The table of
blocks is broadcast; its size is bounded by ``most_blocks``. An exact join must follow where a hit counts:
a crowded filter lets more rows through, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.names import spare

LANES = 4


def blocks_for(keys: int, bits: int = 32, most_blocks: int = 1 << 18) -> int:
    """Blocks of 256 bits for so many keys with ``bits`` for each, at most ``most_blocks`` (2**18: 8 MB)."""
    return max(1, min(most_blocks, -(-keys * bits // (64 * LANES))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, lane: int) -> Column:
    """One bit of the lane's 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(lane)), F.lit(64)).cast("int"))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """block and lane0.. of the filter of a column."""
    masks = keys.select(_block(F.col(key), blocks).alias("block"), *(_mask(F.col(key), i).alias(f"lane{i}") for i in range(LANES)))
    return masks.groupBy("block").agg(*(F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)))


def marked(rows: DataFrame, key: str, filter_: DataFrame, blocks: int) -> tuple[DataFrame, str]:
    """``rows`` with one more column, and its name: whether the filter may hold the key (false for a null one)."""
    block, may, *lanes = spare(rows.columns, "block", "may", *(f"lane{i}" for i in range(LANES)))
    bits = filter_.toDF(block, *lanes)
    joined = rows.withColumn(block, _block(F.col(key), blocks)).join(F.broadcast(bits), block, "left")
    hit = F.col(key).isNotNull()
    for i, lane in enumerate(lanes):
        hit = hit & (F.col(lane).bitwiseAND(_mask(F.col(key), i)) != 0)
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(may)), may


def may_hold(rows: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    own, may = marked(rows, key, filter_, blocks)
    return own.where(F.col(may)).drop(may)


def only_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Left semi join with ``keys`` (distinct values of the same column): what the filter rules out is never
    shuffled."""
    blocks = blocks_for(keys.count())
    return may_hold(rows, key, bloom(keys, key, blocks), blocks).join(keys, key, "left_semi")


def without_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Left anti join with ``keys`` (distinct): rows that the filter rules out pass by, the others are looked up."""
    blocks = blocks_for(keys.count())
    own, may = marked(rows, key, bloom(keys, key, blocks), blocks)
    return own.where(~F.col(may)).drop(may).unionByName(own.where(F.col(may)).drop(may).join(keys, key, "left_anti").select(rows.columns))
