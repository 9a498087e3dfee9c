"""Joins whose hot keys are dealt over several tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.names import spare


def hot_keys(rows: DataFrame, keys: str | Sequence[str], part_rows: int = 256, most_hot: int = 1 << 14, count: str | None = None) -> DataFrame | None:
    """The keys of more than ``part_rows`` rows (or more, if else there were over ``most_hot`` such keys) with the number
    of parts that each is dealt over, as ``parts``; None without any. At most ``most_hot`` rows. Null keys aren't there:
    they match nothing. With ``count``, ``rows`` has one row a key, and this column says how many it stands for."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if count is None:
        (count,) = spare(keys, "count")
        rows = rows.groupBy(*keys).agg(F.count("*").alias(count))
    sizes, (parts,) = rows, spare([*keys, count], "parts")
    null = reduce(Column.__or__, (F.col(c).isNull() for c in keys))
    n, top = sizes.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    limit = max(part_rows, -(-n // most_hot))
    return None if top <= limit else sizes.where((F.col(count) > limit) & ~null).select(*keys, F.ceil(F.col(count) / limit).cast("long").alias(parts))


def spread_join(rows: DataFrame, table: DataFrame, keys: str | Sequence[str], how: str = "inner", counted: DataFrame | None = None, hint: str | None = None, part_rows: int = 256, most_hot: int = 1 << 14) -> DataFrame:
    """``rows.join(table, keys, how)``, where ``how`` is ``inner`` or ``left`` and ``table`` has few rows a key.

    A hot key (see ``hot_keys``) is dealt by a hash of the whole row over as many parts as it needs, and its rows of
    ``table`` are copied for each part. All copies together are fewer than twice ``most_hot`` for each row that
    ``table`` has of a key. Rows with a null key match nothing and are dealt too. Keys are counted in ``counted``, or in
    ``rows``, which is then read twice and so should be a written table or a scan. ``hint`` is a join hint for ``table``.
    """
    return dealt_join(rows, table, keys, hot_keys(rows if counted is None else counted, keys, part_rows, most_hot), how, hint, most_hot)


def dealt_join(rows: DataFrame, table: DataFrame, keys: str | Sequence[str], hot: DataFrame | None, how: str = "inner", hint: str | None = None, most_hot: int = 1 << 14) -> DataFrame:
    """``spread_join`` with hot keys that are known already: what ``hot_keys`` found, as for several joins of the same
    rows, or for rows of which each key has no more than there."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if hot is None:
        return rows.join(table.hint(hint) if hint else table, keys, how)
    parts, part = spare([*rows.columns, *table.columns], "parts", "part")
    null = reduce(Column.__or__, (F.col(c).isNull() for c in keys))
    hot = F.broadcast(hot.toDF(*keys, parts))
    whole = F.xxhash64(*(f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))
    place = F.when(null, F.pmod(whole, F.lit(most_hot))).otherwise(F.pmod(whole, F.coalesce(parts, F.lit(1)).cast("long")))
    left = rows.join(hot, keys, "left").withColumn(part, place).drop(parts)
    right = table.join(hot, keys, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1)).cast("long") - 1))).drop(parts)
    return left.join(right.hint(hint) if hint else right, [*keys, part], how).drop(part)
