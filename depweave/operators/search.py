"""Text search by trigrams: postings of a pattern's rarest trigrams are intersected, what is left is checked in full."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.names import spare
from depweave.sources import ledger
from depweave.sources.scratch import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Lookup:
    """The ``grams`` rarest trigrams of a pattern are intersected. Where even the rarest has more than ``most`` postings,
    reading all rows is no worse, and the index isn't used. Up to ``few`` keys become a filter that a scan prunes by."""

    grams: int = 8
    most: int = 1 << 17
    few: int = 10


def ascii_lower(text: str | Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def add_texts(rows: DataFrame, key: str, texts: list[str], path: str, fold: Callable[[str], Column] = ascii_lower) -> int:
    """Add rows to the index at ``path``: a posting (gram, key) for each trigram in any of a row's folded ``texts``. Returns
    the number of the batch; one that fails leaves the index as it was.

    Postings are in ranges of gram and key, so a lookup reads the row groups of its grams only, and a gram that most rows
    have is in many files. Rows that come again, or with another text, are simply added: postings that hold no longer
    cost a check. Texts are read by code points and at any length; null and those under three characters have none.
    """
    # Matches begin at each place and take nothing, so that trigrams overlap.
    grams = (F.regexp_extract_all(fold(t), F.lit("(?s)(?=(...))"), F.lit(1)) for t in texts)
    every = F.array_distinct(F.concat(*(F.coalesce(g, F.array().cast("array<string>")) for g in grams)))
    found = rows.select(F.explode(every).alias("gram"), F.col(key).alias("key"))
    return ledger.publish(found.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key"), path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """gram, key of all batches that were written to their end."""
    return spark.read.parquet(*(f"{path}/version-{v}" for v in ledger.versions(spark, path)))


def may_hold(index: DataFrame, runs: Iterable[str], how: Lookup | None = None) -> DataFrame | None:
    """key of what may hold all ``runs`` (folded as the index is), each once and surely if it does; None where the index
    can't tell: no run of three characters, or each is too frequent. At most ``how.most`` rows."""
    how = how or Lookup()
    wanted = sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})
    if not wanted:
        return None
    held = index.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count("*").alias("n"))
    counts = {r.gram: r.n for r in held.collect()}  # at most a row a trigram of the pattern
    rare = sorted(wanted, key=lambda g: (counts.get(g, 0), g))[: how.grams]
    if counts.get(rare[0], 0) > how.most:
        return None
    keys = index.where(F.col("gram").isin(rare)).groupBy("key").agg(F.collect_set("gram").alias("held"))
    return keys.where(F.size("held") == len(rare)).select("key")


def narrowed(rows: DataFrame, key: str, index: DataFrame, runs: Iterable[str], how: Lookup | None = None) -> DataFrame:
    """The rows whose key ``may_hold`` the runs; all where the index can't tell. All rows must be in the index."""
    how = how or Lookup()
    keys = may_hold(index, runs, how)
    if keys is None:
        return rows
    keys = cut(keys, "hits")
    some = [r.key for r in keys.limit(how.few + 1).collect()]
    if len(some) <= how.few:
        inside = F.col(key).isin([k for k in some if k is not None])
        return rows.where(inside | F.col(key).isNull() if None in some else inside)
    (name,) = spare(rows.columns, "key")
    keys = keys.toDF(name)
    return rows.join(F.broadcast(keys), rows[key].eqNullSafe(keys[name]), "left_semi")
