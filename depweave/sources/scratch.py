"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.functions.names import spare

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves a local master; on a cluster an unset folder is an
    error, since a machine's own folder is not visible to the other machines.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='depweave-')}")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/depweave/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, through Hadoop, so any file system will do. Nothing there is fine."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """The numbers after ``prefix`` in the names of a folder's entries; through Hadoop, so any file system will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def clear(spark: SparkSession) -> None:
    """Delete all that this application has cut so far. Results are read from it until they are written elsewhere, so
    this is for the end of an application or between its jobs."""
    remove(spark, _root(spark))


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, a lost executor
    loses none of it, and later plans know its size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with numbers from 1 in the given order: sorted ranges are written, and each range's rows follow
    the counts of those before it. Only counts, one row a range, meet in one task."""
    at, place, ahead, n = spare([*df.columns, out], "range", "place", "ahead", "n")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.withColumns({at: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(at).agg(F.count("*").alias(n)).select(at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    return rows.join(F.broadcast(ranges), at).withColumn(out, F.col(ahead) + F.col(place) + 1).drop(at, place, ahead)
