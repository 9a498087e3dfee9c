"""Numbered versions of a table in a folder: each is written once, and counts from when it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.sources.scratch import numbers, whole


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are whole, in order."""
    return [v for v in numbers(spark, path, "version-") if whole(spark, f"{path}/version-{v}")]


def publish(rows: DataFrame, path: str) -> int:
    """Write ``rows`` as the next version and return its number (C4, C6). A write that fails, or is cut off, leaves the
    versions that are there as they are, and its remains are overwritten by the next one of that number. One writer at a
    time."""
    number = max(versions(rows.sparkSession, path), default=0) + 1
    rows.write.mode("overwrite").parquet(f"{path}/version-{number}")
    return number


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, by default the newest, with its number as ``version``."""
    number = max(versions(spark, path)) if version is None else version
    return spark.read.parquet(f"{path}/version-{number}").withColumn("version", F.lit(number).cast("long"))
