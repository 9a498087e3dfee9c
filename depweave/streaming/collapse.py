"""The change log as a stream: net deltas kept up to date in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.operators.changes import collapse_state, net_changes
from depweave.sources.scratch import numbers, remove, whole

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB while a query starts: on local disk with change files in the checkpoint, not in the JVM's heap."""
    held = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if held is None else spark.conf.set(_STORE, held)


def collapsed(changes: DataFrame, key_cols: Sequence[str] = ("entity_type", "entity_id"), order_cols: Sequence[str] = ("ord",), event_time: str | None = None, delay: str = "1 hour", identity: Sequence[str] = ("ord",)) -> DataFrame:
    """The streaming form of ``collapse_state``: (n, first, last) per entity as a stateful aggregation, whatever order
    records come in. With ``event_time`` (a timestamp column) a record that comes again, as ``identity`` tells, within
    ``delay`` of event time counts once; the watermark lets go of identities older than that."""
    if event_time is not None:
        changes = changes.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(identity))
    return collapse_state(changes, key_cols, order_cols)


def stream_collapse(
    spark: SparkSession, log_dir: str, schema: T.StructType, state_dir: str, key_cols: Sequence[str] = ("entity_type", "entity_id"), order_cols: Sequence[str] = ("ord",), files_per_batch: int = 1000, event_time: str | None = None, delay: str = "1 hour", compact_after: int = 16
) -> DataFrame:
    """Take in the new files of ``log_dir`` (Parquet) and return the net deltas of all records so far.

    The state per entity is a streaming aggregation in the RocksDB state store, with its checkpoint in
    ``state_dir/progress``: a query that is killed goes on from there. Each batch puts out the entities that it changed,
    to ``state_dir/changed-b``; a batch that is run again writes the same again. An entity's last row is its state; rows
    of batches that aren't committed don't count. After ``compact_after`` batches what they put out is folded into
    ``state_dir/folded-b`` and deleted. ``event_time`` and ``delay`` are as in ``collapsed``.
    """

    def put_out(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{state_dir}/changed-{batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
    with _rocks(spark):
        query = collapsed(stream, key_cols, order_cols, event_time, delay).writeStream.outputMode("update").foreachBatch(put_out)
        query = query.option("checkpointLocation", f"{state_dir}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    state = current_state(spark, state_dir, schema, key_cols, order_cols, compact_after)
    return net_changes(state, key_cols)


def last_batch(spark: SparkSession, progress: str) -> int:
    """The last batch that the stream has committed, -1 before the first."""
    return max(numbers(spark, f"{progress}/commits"), default=-1)


def current_state(spark: SparkSession, state_dir: str, schema: T.StructType, key_cols: Sequence[str], order_cols: Sequence[str], compact_after: int = 16) -> DataFrame:
    """The last state of each entity of all committed batches."""
    shape = collapse_state(spark.createDataFrame([], schema), key_cols, order_cols)
    last = last_batch(spark, f"{state_dir}/progress")
    folded = max((b for b in numbers(spark, state_dir, "folded-") if whole(spark, f"{state_dir}/folded-{b}")), default=-1)
    batches = [b for b in numbers(spark, state_dir, "changed-") if folded < b <= last]
    paths = [(b, f"{state_dir}/changed-{b}") for b in batches] + ([(folded, f"{state_dir}/folded-{folded}")] if folded >= 0 else [])
    if not paths:
        return shape
    rows = None
    for b, path in paths:
        one = spark.read.schema(shape.schema).parquet(path).withColumn("_batch", F.lit(b))
        rows = one if rows is None else rows.unionByName(one)
    state = rows.groupBy(*key_cols).agg(F.max_by(F.struct("n", "first", "last"), "_batch").alias("s")).select(*key_cols, "s.*")
    if len(batches) <= compact_after:
        return state
    state.write.mode("overwrite").parquet(f"{state_dir}/folded-{last}")
    for _, path in paths:
        remove(spark, path)
    return spark.read.schema(shape.schema).parquet(f"{state_dir}/folded-{last}")
