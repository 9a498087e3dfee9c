"""Approximate nearest neighbours by inverted lists with an adaptive dimension scan.

Largest inner product becomes least distance by one more component, sqrt(longest**2 - |x|**2), that a query
has as 0. A random rotation spreads a distance evenly over the dimensions, so the distance over the first d
of D dimensions, scaled by D / d, estimates the whole. Vectors are kept in lists around centroids that were
fitted on a bounded sample. A query probes its nearest lists; in each, candidates are scanned a column block
at a time and abandoned once a hypothesis test says that their distance exceeds the kth best so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.store import save
from depweave.llm.vectors import best, finite, matrix, top_rows


@dataclass(frozen=True)
class Probing:
    """``sample``: vectors that centroids and the number of probes are fitted on (expected; twice that at
    most). ``list_rows``: rows of a list on average. The probes are the fewest that reach ``recall`` on the
    sample. ``doubt``: how many deviations the test of a partial distance allows. Some lists of about
    ``tile_docs`` rows together and up to ``tile_queries`` queries are one tile, which one task holds."""

    k: int = 20
    every: int = 20
    sample: int = 16384
    list_rows: int = 1024
    most_lists: int = 4096
    recall: float = 0.97
    columns: int = 32
    doubt: float = 3.0
    tile_docs: int = 8192
    tile_queries: int = 2048
    seed: int = 5


@dataclass(frozen=True)
class Lists:
    """``centroids`` in the rotated space; ``probes`` of a query; ``longest`` squared length of a vector."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    longest: float


def _rotation(width: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width + 1, width + 1)))
    return q * np.sign(np.diag(r))


def placed(x: np.ndarray, rotation: np.ndarray, longest: float | None) -> np.ndarray:
    """Rotated vectors with the component that makes inner products distances; None: of queries."""
    more = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(0.0, longest - (x * x).sum(1)))
    return np.concatenate((x, more[:, None]), axis=1) @ rotation


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def fit(sample: np.ndarray, n: int, longest: float, how: Probing) -> Lists:
    """Centroids by k-means on the sample, and the probes that reach ``recall`` of its own neighbours."""
    rng = np.random.default_rng(how.seed)
    rotation = _rotation(sample.shape[1], how.seed)
    x = placed(sample, rotation, longest)
    count = max(1, min(how.most_lists, n // how.list_rows, len(x) // 8))
    centroids = x[rng.choice(len(x), count, replace=False)].copy()
    for _ in range(8):
        own = _distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=count)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    own = _distances(x, centroids).argmin(1)
    tried = rng.choice(len(x), min(len(x), 512), replace=False)
    scores = sample[tried] @ sample.T
    scores[np.arange(len(tried)), tried] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(how.k, len(x) - 1)]
    place = np.argsort(np.argsort(_distances(placed(sample[tried], rotation, None), centroids), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(how.recall * len(needed)))]) if len(needed) else count
    return Lists(rotation, centroids, min(count, probes), longest)


def scan(px: np.ndarray, pq: np.ndarray, same: np.ndarray, kth: np.ndarray, how: Probing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) positions of one list that survive all column blocks.

    ``same``: pairs of a query with itself. ``kth``: each query's kth best squared distance so far.
    """
    width, slack = px.shape[1], _slack(px, pq)
    part = _distances(pq[:, : how.columns], px[:, : how.columns])
    part[same] = np.inf
    # Queries without a kth yet get one from twice k candidates that look nearest, by whole distance.
    fresh = np.flatnonzero(np.isinf(kth))
    if part.shape[1] > how.k and len(fresh):
        own = part[fresh]
        first = np.argpartition(own, min(2 * how.k, own.shape[1] - 1), axis=1)[:, : 2 * how.k]
        whole = np.stack([((pq[fresh] - px[f]) ** 2).sum(1) for f in first.T], axis=1)
        whole[np.isinf(np.take_along_axis(own, first, 1))] = np.inf
        kth = kth.copy()
        kth[fresh] = np.partition(whole, how.k - 1, axis=1)[:, how.k - 1]
    seen = min(how.columns, width)
    i, j = np.nonzero((part <= _most(kth, seen, width, how.doubt, slack)[:, None]) & np.isfinite(part))
    sums = part[i, j]
    while seen < width and len(i):
        upto = min(width, seen + how.columns)
        sums = sums + ((pq[i, seen:upto] - px[j, seen:upto]) ** 2).sum(1)
        seen = upto
        keep = sums <= _most(kth, seen, width, how.doubt, slack)[i]
        i, j, sums = i[keep], j[keep], sums[keep]
    return i, j, sums


def search_lists(ids: np.ndarray, x: np.ndarray, list_of: np.ndarray, queries: np.ndarray, q: np.ndarray, probes: list[np.ndarray], lists: Lists, how: Probing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (query position, score, id) of one tile: its lists one after the other, each scanned for
    the queries that probe it, with the kth distance that they have reached so far."""
    px, pq = placed(x, lists.rotation, lists.longest), placed(q, lists.rotation, None)
    asked = np.repeat(np.arange(len(q)), [len(p) for p in probes])
    wanted = np.concatenate(probes) if probes else np.zeros(0, np.int32)
    near = np.full((len(q), how.k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for one in np.unique(list_of):
        rows, cols = asked[wanted == one], np.flatnonzero(list_of == one)
        if not len(rows):
            continue
        i, j, sums = scan(px[cols], pq[rows], queries[rows][:, None] == ids[cols][None, :], near[rows, -1], how)
        # Cut by what the result is ordered by: equally near vectors stay by vec_id, not by place in the tile.
        i, j = _within_kth(rows[i], cols[j], sums, _slack(px, pq), how.k)
        at, score, vec = top_rows(i, _scores(q, x, i, j), ids[j], how.k)
        place = np.arange(len(at)) - np.searchsorted(at, at)
        more = np.full((len(q), how.k), np.inf)
        more[at, place] = np.maximum(0, (q[at] ** 2).sum(1) + lists.longest - 2 * score)
        near = np.sort(np.concatenate((near, more), axis=1), axis=1)[:, : how.k]
        found.append((at, score, vec))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    at, score, vec = (np.concatenate(c) for c in zip(*found, strict=True))
    return top_rows(at, score, vec, how.k)


def _slack(px: np.ndarray, pq: np.ndarray) -> np.ndarray:
    """By how much rounding may move a squared distance of each query."""
    return 1e-12 * (1 + (pq * pq).sum(1) + (px * px).sum(1).max(initial=0))


def _within_kth(i: np.ndarray, j: np.ndarray, sums: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that are no farther than the kth of their query, or only by rounding: ties all stay."""
    order = np.lexsort((sums, i))
    i, j, sums = i[order], j[order], sums[order]
    start, end = np.searchsorted(i, i), np.searchsorted(i, i, side="right")
    kth = sums[np.minimum(start + k, end) - 1]
    keep = sums <= kth * (1 + 1e-9) + slack[i]
    return i[keep], j[keep]


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, rows: int = 65536) -> np.ndarray:
    """Inner products of pairs, each by itself, so that copies of a vector score the same; some rows at a time."""
    parts = [np.einsum("ij,ij->i", q[i[at : at + rows]], x[j[at : at + rows]]) for at in range(0, len(i), rows)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _most(kth: np.ndarray, seen: int, width: int, doubt: float, slack: np.ndarray) -> np.ndarray:
    """A partial distance over ``seen`` dimensions above this is taken to be of a whole one above ``kth``.

    Under a random rotation the share of a squared distance in ``seen`` of ``width`` dimensions has a beta
    distribution, of mean seen / width; the test allows ``doubt`` of its standard deviations."""
    if seen >= width:
        return kth * (1 + 1e-9) + slack
    spread = np.sqrt(2 * seen * (width - seen) / (width * width * (width + 2)))
    return kth * min(1.0, seen / width + doubt * spread) + slack


def nearest(table: DataFrame, how: Probing | None = None, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row whose vec_id is divisible by ``every``.

    The score is the inner product of the original vectors in doubles. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do rows without vec_id; short vectors are filled up
    with zeros. Other columns, whatever their names, aren't read. Equal scores go by the smaller vec_id. Rows that repeat a vec_id are candidates of their own but one query: the smallest of their vectors.
    Every row is in some list; long lists are dealt over several tiles. A query whose lists hold fewer than ``k``
    candidates searches all lists, so it is short only where the table is. An empty table gives an empty result.
    """
    how = how or Probing()
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.where(F.col("vec_id").isNotNull() & finite("v")).where(F.exists("v", lambda x: x != 0)).withColumn("square", squares)
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max("square")).first()
    out = "query_id long, vec_id long, score double"
    if not n:
        return best(table.sparkSession.createDataFrame([], out), how.k)
    chance = F.pmod(F.xxhash64("vec_id", F.lit(how.seed)), F.lit(1 << 20))
    drawn = rows.where(chance < (1 << 20) * min(1.0, how.sample / n)).select("v").limit(2 * how.sample)
    sample = matrix(drawn.toArrow()["v"], width)
    if len(sample) < 2:  # a table of a few rows
        sample = matrix(rows.select("v").limit(how.sample).toArrow()["v"], width)
    lists = fit(sample, n, longest, how)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _distances(placed(matrix(batch.column(1), width), lists.rotation, lists.longest), lists.centroids).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32())], names=["vec_id", "v", "list"])

    groups = max(1, min(len(lists.centroids), -(-n // how.tile_docs)))
    index = save(rows.select("vec_id", "v").mapInArrow(keyed, "vec_id long, v array<double>, list int"), "ann-index")
    # One row a group of lists, of which there are ``most_lists`` at most. A long list is dealt over parts.
    index = index.withColumn("tile", F.col("list") % groups)
    shape = index.groupBy("tile").agg(F.ceil(F.count("*") / (2 * how.tile_docs)).cast("int").alias("parts"))
    key = F.xxhash64("vec_id")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def searched(queries: DataFrame, probes: int) -> DataFrame:
        """The best of the ``probes`` nearest lists for queries (vec_id, v)."""

        def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = _distances(placed(matrix(batch.column(1), width), lists.rotation, None), lists.centroids)
                to = np.argsort(away, axis=1)[:, :probes].astype(np.int32)
                for g in range(groups):  # of each group of lists the probed ones
                    own = to % groups == g
                    rows = np.flatnonzero(own.any(1))
                    ends = np.concatenate(([0], np.cumsum(own[rows].sum(1)))).astype(np.int32)
                    wanted = pa.ListArray.from_arrays(pa.array(ends), pa.array(to[rows][own[rows]], pa.int32()))
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(rows), g, np.int32)), wanted], names=["vec_id", "v", "tile", "probes"])

        asked = save(queries.mapInArrow(probing, "vec_id long, v array<double>, tile int, probes array<int>"), "ann-queries")
        turns = asked.groupBy("tile").agg(F.ceil(F.count("*") / how.tile_queries).cast("int").alias("turns"))
        plan = F.broadcast(shape.join(turns, "tile"))
        docs = index.join(plan, "tile").select("vec_id", "v", "list", "tile", F.pmod(F.xxhash64("vec_id", "v"), "parts").cast("int").alias("part"), each("turns").alias("turn"))
        asked = asked.join(plan, "tile").select("vec_id", "v", "probes", "tile", each("parts").alias("part"), F.pmod(key, "turns").cast("int").alias("turn"))

        def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
            kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
            if not docs.num_rows or not queries.num_rows:
                return kinds.empty_table()
            x, q = (matrix(t["v"], width) for t in (docs, queries))
            ids, of = (t["vec_id"].to_numpy() for t in (docs, queries))
            wanted = [np.array(p, np.int32) for p in queries["probes"].to_pylist()]
            at, score, vec = search_lists(ids, x, docs["list"].to_numpy(), of, q, wanted, lists, how)
            return pa.table([pa.array(of[at]), pa.array(vec), pa.array(score)], schema=kinds)

        tile = ["tile", "part", "turn"]
        return best(docs.groupBy(*tile).cogroup(asked.groupBy(*tile)).applyInArrow(run, out), how.k)

    asked = rows.where(F.pmod("vec_id", F.lit(how.every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("copies"))
    found = save(searched(asked.select("vec_id", "v"), lists.probes), "ann-found")
    # Where the probed lists held fewer than there are to be found, all lists are searched.
    have = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("have"))
    short = asked.join(have, "vec_id", "left").where(F.coalesce("have", F.lit(0)) < F.least(F.lit(how.k), n - F.col("copies")))
    short = save(short.select("vec_id", "v"), "ann-short")
    if short.isEmpty():
        return found
    kept = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return kept.unionByName(searched(short, len(lists.centroids))).select("query_id", "rank", "vec_id", "score")
