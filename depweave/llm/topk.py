"""Exact top-k inner products by block-at-a-time pruning.

Every vector is a document of 2 * dimensions terms: a component counts for the positive or the negative
term. Each tile holds some documents and some queries. Its documents are laid out in ranges of similar ones;
each block of a range keeps its term maxima and, as forward index, its rows. A query's bound for a block is
the sum of its weights times the maxima. Blocks are taken by falling bound, and a query stops at the first
bound below its kth score. A first tile of drawn documents gives each query a kth score that all other tiles start
from. All numbers are integers in doubles (exact below 2**53, else Python integers).
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.store import save
from depweave.llm.vectors import best, finite, matrix


@dataclass(frozen=True)
class BlockSearch:
    """``tile_docs`` and ``tile_queries`` bound what one task holds; ``least_tiles`` spreads small tables. The first
    tile has about ``seeds`` documents, or a thirty-second of all."""

    k: int = 10
    every: int = 100
    scale: int = 1024
    block: int = 64
    tile_docs: int = 8192
    tile_queries: int = 2048
    least_tiles: int = 32
    seeds: int = 8192


def _layout(x: np.ndarray, block: int) -> np.ndarray:
    """An order that puts similar rows side by side: by the nearest of some of them, then by the second."""
    pivots = x[:: max(1, len(x) // 32)][:32]
    near = np.argsort(-(x @ pivots.T), axis=1)[:, :2]
    return np.lexsort((near[:, 1] if near.shape[1] > 1 else near[:, 0], near[:, 0]))


def search_tile(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, how: BlockSearch, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (query, score, id) of one tile, of those that reach each query's ``least`` score; x and q hold
    integers."""
    least = np.full(len(q), -np.inf) if least is None else least
    order = _layout(x, how.block)
    ids, x = ids[order], x[order]
    starts = np.arange(0, len(x), how.block)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bounds = np.maximum(q, 0) @ np.maximum(high, 0).T + np.maximum(-q, 0) @ np.maximum(-low, 0).T
    by_bound = np.argsort(-bounds, axis=1, kind="stable")
    kth = least.copy()
    held_s = np.full((len(q), how.k), -np.inf)
    held_i = np.full((len(q), how.k), np.iinfo(np.int64).max)
    active = np.arange(len(q))
    for turn in range(len(starts)):
        at = by_bound[active, turn]
        open_ = bounds[active, at] >= kth[active]  # an equal bound may still hold a smaller id
        active, at = active[open_], at[open_]
        if not len(active):
            break
        for b in np.unique(at):
            rows = active[at == b]
            part = slice(starts[b], starts[b] + how.block)
            scores = q[rows] @ x[part].T
            scores[queries[rows][:, None] == ids[part][None, :]] = -np.inf
            both_s = np.concatenate((held_s[rows], scores), axis=1)
            both_i = np.concatenate((held_i[rows], np.broadcast_to(ids[part], scores.shape)), axis=1)
            first = np.lexsort((both_i, -both_s), axis=1)[:, : how.k]
            held_s[rows], held_i[rows] = np.take_along_axis(both_s, first, 1), np.take_along_axis(both_i, first, 1)
            kth[rows] = np.maximum(least[rows], held_s[rows, -1])
    found = (held_s > -np.inf) & (held_s >= least[:, None])
    return np.broadcast_to(queries[:, None], found.shape)[found], held_s[found], held_i[found]


LONG = 1 << 63


def _whole(v: float, scale: int) -> int:
    return int(v) * scale if abs(v) >= 2**53 else math.floor(scale * v)


def _plain(ids, x, queries, q, how):
    """The same by whole-number arithmetic of any size, for components beyond what doubles add exactly. Scores beyond
    a long count as the nearest long."""
    x, q = ([[_whole(float(v), how.scale) for v in row] for row in y] for y in (x, q))
    clipped = lambda u, v: max(-LONG, min(LONG - 1, sum(a * b for a, b in zip(u, v, strict=True))))
    out = []
    for i, u in zip(queries.tolist(), q, strict=True):
        scored = [(i, clipped(u, v), j) for j, v in zip(ids.tolist(), x, strict=True) if i != j]
        out += heapq.nsmallest(how.k, scored, key=lambda s: (-s[1], s[2]))
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def exact_top_k(table: DataFrame, how: BlockSearch | None = None, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row whose vec_id is divisible by ``every``.

    A component x counts as floor(scale * x) with x as double. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows without vec_id; short vectors are filled up with zeros.
    Other columns, whatever their names, aren't read. Equal scores go by the smaller vec_id. Fewer candidates than ``k``
    are all returned. Rows that repeat a vec_id are candidates of their own
    (never for that id's own query) but one query: the smallest of their vectors. A score beyond a long counts as the
    nearest long. An empty table gives an empty result.
    """
    how = how or BlockSearch()
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & finite("v"))
    asked = save(rows.where(F.pmod("vec_id", F.lit(how.every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked = asked.count()
    width = width or 1
    tiles = max(how.least_tiles, -(-n // how.tile_docs))
    turns = max(1, -(-n_asked // how.tile_queries))
    key = F.xxhash64("vec_id")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def searched(docs: DataFrame, queries: DataFrame, tiles: int) -> DataFrame:
        """The ``k`` best of each tile; ``queries`` have a ``least`` score or null."""
        # Whole rows are hashed, so that rows of one vec_id are dealt too.
        docs = docs.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).cast("int").alias("tile"), every(turns).alias("turn"))
        queries = queries.select("vec_id", "v", "least", every(tiles).alias("tile"), F.pmod(key, F.lit(turns)).cast("int").alias("turn"))

        def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
            if not docs.num_rows or not queries.num_rows:
                return kinds.empty_table()
            raw = [matrix(t["v"], width) for t in (docs, queries)]
            x, q = (np.floor(how.scale * m) for m in raw)
            ids, of = (t["vec_id"].to_numpy() for t in (docs, queries))
            if np.abs(x).max() * np.abs(q).max() * width < 2**53:
                least = np.array([-np.inf if v is None else v for v in queries["least"].to_pylist()], np.float64)
                query, score, vec = search_tile(ids, x, of, q, how, least)
            else:
                query, score, vec = _plain(ids, raw[0], of, raw[1], how)
            return pa.table([pa.array(c, pa.int64()) if isinstance(c, list) else pa.array(c.astype(np.int64)) for c in (query, vec, score)], schema=kinds)

        return docs.groupBy("tile", "turn").cogroup(queries.groupBy("tile", "turn")).applyInArrow(run, "query_id long, vec_id long, score long")

    plain = asked.withColumn("least", F.lit(None).cast("long"))
    seeds = min(how.seeds, n // 32)
    if seeds > how.k:
        chance = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20))
        drawn = rows.where(chance < (1 << 20) * min(1.0, seeds / n)).limit(2 * seeds)
        # The kth of some documents is no higher than that of all.
        kth = searched(drawn, plain, 1).groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("k"), F.min("score").alias("least"))
        plain = asked.join(save(kth.where(F.col("k") >= how.k).select("vec_id", "least"), "topk-least"), "vec_id", "left")
    return best(searched(rows, plain, tiles), how.k)
