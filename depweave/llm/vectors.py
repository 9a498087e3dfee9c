"""What the two vector searches share: valid rows, tiles of bounded size, and the merge of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether the vector is there, not empty, and free of null and non-finite components."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """List rows as doubles, short rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (ends == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(ends), width))
    out[np.arange(width) < ends[:, None]] = values
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores, ties to smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_rows(query: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored (query, id) pairs the ``k`` best of each query."""
    order = np.lexsort((ids, -scores, query))
    query, scores, ids = query[order], scores[order], ids[order]
    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.concatenate((start, [len(query)]))))
    keep = place < k
    return query[keep], scores[keep], ids[keep]
