"""Constraints as jobs: each returns its violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_owner(decisions: DataFrame) -> DataFrame:
    """Decisions that have both or neither of module and component (V1)."""
    return decisions.where(F.col("module_id").isNull() == F.col("component_id").isNull())


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with n; keys with a null are exempt (V2)."""
    rows = df
    for c in cols:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def check_fk(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str) -> DataFrame:
    """Child rows whose reference isn't null and has no parent (V3)."""
    keys = parent.select(F.col(parent_col).alias("_k")).distinct()
    return child.where(F.col(child_col).isNotNull()).join(keys, F.col(child_col) == F.col("_k"), "left_anti")


def check_clustering(source_files: DataFrame, component_files: DataFrame, low: int = 3, high: int = 50) -> DataFrame:
    """Issues (kind, detail): source files in no component, component files that are no source, and a count of
    components outside [low, high] (V4)."""
    left = source_files.select("path").join(component_files.select("path"), "path", "left_anti").select(F.lit("not clustered").alias("kind"), F.col("path").alias("detail"))
    extra = component_files.select("path").join(source_files.select("path"), "path", "left_anti").select(F.lit("not a source file").alias("kind"), F.col("path").alias("detail"))
    count = component_files.agg(F.countDistinct("component").alias("n")).where(~F.col("n").between(low, high)).select(F.lit("component count").alias("kind"), F.col("n").cast("string").alias("detail"))
    return left.unionByName(extra).unionByName(count)


def upgrade_table(df: DataFrame, schema: T.StructType, key: Sequence[str] | None = None) -> DataFrame:
    """``df`` in the schema: missing columns as null, others cast; with ``key`` one row for each (V5)."""
    have = {c.lower() for c in df.columns}
    rows = df.select(*((F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
    if not key:
        return rows
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*(F.col(c) if c in key else F.col(f"_r.{c}") for c in rows.columns))


def check_import(maps: DataFrame) -> DataFrame:
    """Modules of a nested map that can't be imported, with the reason (V6)."""
    rows = maps.select(F.explode_outer("modules").alias("m"))
    reason = F.when(F.col("m").isNull(), "no modules").when(F.coalesce(F.trim("m.name"), F.lit("")) == "", "no name")
    return rows.select("m.id", "m.name", reason.alias("reason")).where("reason is not null")
