"""Sharding by longest processing time first: groups that stay together, by size, to the least-loaded shard.

Groups of one size are interchangeable, so the heap's order is known from how many groups there are of each size:
that histogram comes to the driver (a row a distinct size, never groups as such), and the heap deals a whole size at
a time. What it deals of a size are counts per shard. Groups are numbered within their size, by a hash and over many
ranges, and the numbers of a size go to its shards by those counts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.llm.store import save
from depweave.operators.spread import spread_join


@dataclass(frozen=True)
class Shards:
    """``shards``; ``overhead``: bytes that a row takes besides its text. ``range_rows``: rows or groups that a counting
    range holds on average. Up to ``few_sizes`` distinct sizes are broadcast, more are joined."""

    shards: int = 24
    overhead: int = 8
    range_rows: int = 4096
    few_sizes: int = 1 << 13


def byte_size(text: str, how: Shards) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + how.overhead


def _dealt(loads: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` items of one size each shard gets if each item goes to the least-loaded one (ties to the lower).

    Shard i takes its items at the loads loads[i], loads[i] + size, ...; the n smallest of all these are taken."""
    def below(level: int) -> int:
        return sum(max(0, -(-(level - x) // size)) for x in loads)

    low, high = min(loads), max(loads) + size * n + 1
    while high - low > 1:  # the highest level below which at most n items are taken
        middle = (low + high) // 2
        low, high = (middle, high) if below(middle) <= n else (low, middle)
    out = [max(0, -(-(low - x) // size)) for x in loads]
    left = n - sum(out)
    for i, x in enumerate(loads):  # the next ones are all taken at this very level
        if left and x <= low and (low - x) % size == 0:
            out[i], left = out[i] + 1, left - 1
    return out


def schedule(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, ends): for each (size, how many groups), by falling size, up to which number within the size (exclusive)
    groups go to each shard. A size of few groups goes through a heap one by one, a size of many at once."""
    loads, out = [0] * shards, []
    heap = [(0, i) for i in range(shards)]
    for size, n in sorted(histogram, reverse=True):
        counts = [0] * shards
        if n <= 4 * shards or size == 0:
            for _ in range(n if size else 0):
                load, i = heapq.heappop(heap)
                counts[i] += 1
                heapq.heappush(heap, (load + size, i))
                loads[i] += size
            if not size:  # weightless groups all go to the least-loaded shard
                counts[heap[0][1]] = n
        else:
            counts = _dealt(loads, size, n)
            loads = [x + size * c for x, c in zip(loads, counts, strict=True)]
            heap = [(x, i) for i, x in enumerate(loads)]
            heapq.heapify(heap)
        ends, upto = [], 0
        for c in counts:
            upto += c
            ends.append(upto)
        out.append((size, ends))
    return out


def place_groups(groups: DataFrame, how: Shards) -> DataFrame:
    """group, shard of groups (group, bytes); a written table."""
    histogram = [(r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).toLocalIterator()]
    ranges = {size: max(1, -(-n // how.range_rows)) for size, n in histogram}
    plan = schedule(histogram, how.shards)
    plan = pa.table({"bytes": [s for s, _ in plan], "ends": [e for _, e in plan], "ranges": [ranges[s] for s, _ in plan]}, schema=pa.schema([("bytes", pa.int64()), ("ends", pa.list_(pa.int64())), ("ranges", pa.int64())]))
    plan = groups.sparkSession.createDataFrame(plan)
    # Numbers within a size: ranges of the hash, counts of the ranges before, places in the range.
    chance = F.pmod(F.xxhash64("group"), F.lit(1 << 31))
    rows = groups.join(F.broadcast(plan), "bytes") if len(histogram) <= how.few_sizes else spread_join(groups, plan, "bytes")
    rows = rows.withColumn("range", F.floor(chance * F.col("ranges") / F.lit(1 << 31)).cast("long"))
    along = Window.partitionBy("bytes").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bytes", "range").agg(F.count("*").alias("n")).where("n > 0")
    before = counts.select("bytes", "range", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    within = Window.partitionBy("bytes", "range").orderBy("group")
    rows = rows.withColumn("place", F.row_number().over(within) - 1).join(before, ["bytes", "range"])
    number = F.col("before") + F.col("place")
    return rows.select("group", F.size(F.filter("ends", lambda e: e <= number)).cast("int").alias("shard"))


def shard(docs: DataFrame, how: Shards | None = None, group: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (by default all) plus size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    Rows of one group (by default: of equal texts, null counting as empty) share a shard; groups go by falling size
    to the least-loaded shard. Slots number a shard's rows from 0 without gaps. Repeated rows keep a slot each. An
    empty table gives an empty result. Columns named like the new ones are replaced, all other names are free.
    """
    how = how or Shards()
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in columns or docs.columns if c.lower() not in new]
    if group is None:
        group = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    body = F.struct(*(docs[c] for c in kept)) if kept else F.struct(F.lit(0).alias("none"))
    chance = F.xxhash64("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(body.alias("body"), docs["doc_id"].alias("doc_id"), byte_size("text", how).alias("size"), crc.alias("text_crc32"), group.alias("group"), chance.alias("chance"))
    rows = save(rows, "shard-rows")
    groups = save(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = save(place_groups(groups, how), "shard-placed")
    rows = with_slots(spread_join(rows, placed, "group"), how)
    own = [F.col("body")[c].alias(c) for c in kept]
    return rows.select(*own, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(rows: DataFrame, how: Shards) -> DataFrame:
    """``rows`` plus ``slot``: counts per range of a shard, added up along it, then numbers in the range."""
    rows = save(rows, "shard-slots")
    ranges = max(1, -(-rows.count() // (how.range_rows * how.shards)))
    rows = rows.withColumn("range", F.pmod("chance", F.lit(ranges)))
    along = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "group")) - 1
    return rows.withColumn("number", number).join(offsets, ["shard", "range"]).withColumn("slot", (F.col("offset") + F.col("number")).cast("long"))
