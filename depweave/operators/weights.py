"""The weighted file graph: combined weights, noise, directory affinity, hubs.

``nodes`` has (node) or (node, is_virtual), ``edges`` (src, dst, weight) with src < dst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.paths import parent
from depweave.operators.spread import dealt_join, hot_keys, spread_join
from depweave.sources.scratch import cut

#: Weight of a count by edge type: fixed values.
TYPE_WEIGHTS = {"call": 1.0, "import": 0.3, "inheritance": 0.5}


def combine_weights(edges: DataFrame, nodes: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """src, dst, weight: the sum over types of log2(1 + cnt) times the type's weight, for pairs of known
    nodes (A5). Counts of a pair and type are added up first, all types of a pair at once, so edges are shuffled once."""
    weights = weights or TYPE_WEIGHTS
    if nodes is not None:
        own = nodes.select("node").distinct()
        for end in ("src", "dst"):
            edges = edges.join(own.withColumnRenamed("node", end), end, "left_semi")
    sums = [F.coalesce(F.sum(F.when(F.col("edge_type") == kind, F.col("cnt"))), F.lit(0)) for kind in weights]
    added = reduce(Column.__add__, (F.log2(1 + n) * F.lit(float(w)) for n, w in zip(sums, weights.values(), strict=True)), F.lit(0.0))
    return edges.groupBy("src", "dst").agg(added.alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: distinct neighbours of nodes that have edges."""
    pairs = edges.select("src", "dst").distinct()
    return pairs.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def average_degree(edges: DataFrame) -> DataFrame:
    """One row avg_degree over the nodes that have edges, 0 without any."""
    return degrees(edges).agg(F.coalesce(F.avg("degree"), F.lit(0.0)).alias("avg_degree"))


def _picked(counts: DataFrame, value: str, place: Column) -> DataFrame:
    """partition and the value at the 0-based ``place`` among all of the partition, in ascending order.

    ``counts`` has (partition, value, n) for each distinct value, so the ordered window sees a row per distinct
    value and not per node."""
    each = Window.partitionBy("partition")
    upto = counts.withColumn("_upto", F.sum("n").over(each.orderBy(value))).withColumn("_all", F.sum("n").over(each))
    return upto.where(F.col("_upto") > place).groupBy("partition").agg(F.min(value).alias(value))


def _parted(edges: DataFrame, partition: DataFrame | None) -> DataFrame:
    """The edges inside partitions (node, partition), written with their partition; all in one without any."""
    rows = edges.select("src", "dst", "weight")
    if partition is None:
        return cut(rows.withColumn("partition", F.lit("__all__")), "weighted")
    own, rows = partition.select("node", "partition"), cut(rows, "weighted")
    rows = spread_join(rows, own.select(F.col("node").alias("src"), "partition"), "src", counted=rows.select("src"))
    rows = spread_join(rows, own.select(F.col("node").alias("dst"), F.col("partition").alias("_q")), "dst", counted=rows.select("dst")).where("partition = _q")
    return cut(rows.select("src", "dst", "weight", "partition"), "weighted")


def _facts(rows: DataFrame, facts: DataFrame, partition: DataFrame | None) -> DataFrame:
    """``rows`` with the facts of their partition: one row without partitions, else left to the planner."""
    return rows.join(F.broadcast(facts) if partition is None else facts, "partition")


def _degrees_by(edges: DataFrame) -> DataFrame:
    """node, partition, degree of edges that are inside partitions, written once for all that read it."""
    pairs = edges.select("src", "dst", "partition").distinct()
    return cut(pairs.select(F.explode(F.array("src", "dst")).alias("node"), "partition").groupBy("node", "partition").agg(F.count("*").alias("degree")), "degrees")


def _with_degrees(edges: DataFrame, deg: DataFrame) -> DataFrame:
    """Edges with the degrees of both ends; a hub's edges, as many as its degree at most, are dealt over tasks."""
    hubs = hot_keys(deg, "node", count="degree")
    for end in ("src", "dst"):
        table = deg.select(F.col("node").alias(end), F.col("degree").alias(f"_{end}"))
        edges = dealt_join(edges, table, end, None if hubs is None else hubs.withColumnRenamed("node", end))
    return edges


def drop_noise(edges: DataFrame, partition: DataFrame | None = None, sparse_degree_threshold: float = 6.0, weak: float = 0.5) -> DataFrame:
    """Where the average degree of nodes with edges reaches the threshold, without edges lighter than ``weak`` whose
    ends both have at most the upper median degree (A8). With ``partition`` (node, partition) each partition has its
    own degrees, average and median, and edges between partitions go."""
    edges = _parted(edges, partition)
    deg = _degrees_by(edges)
    median = _picked(deg.groupBy("partition", "degree").agg(F.count("*").alias("n")), "degree", F.floor(F.col("_all") / 2))
    gate = deg.groupBy("partition").agg(F.avg("degree").alias("_average")).join(median.withColumnRenamed("degree", "_median"), "partition")
    rows = _with_degrees(_facts(edges, gate, partition), deg)
    noise = (F.col("_average") >= sparse_degree_threshold) & (F.col("weight") < weak) & (F.col("_src") <= F.col("_median")) & (F.col("_dst") <= F.col("_median"))
    return rows.where(~noise).select("src", "dst", "weight")


#: A directory up to FEW files is a clique of full weight, up to SOME of damped weight, beyond that a star.
FEW, SOME = 4, 10


def directory_affinity(nodes: DataFrame) -> DataFrame:
    """src, dst, weight of files that share a directory, through a virtual node where it has many.

    Pairs are made only within directories of at most SOME files."""
    rows = nodes.select("node").distinct().withColumn("dir", parent("node"))
    sizes = rows.groupBy("dir").agg(F.count("*").alias("n")).where("n >= 2")
    rows = rows.join(sizes, "dir")
    damped = F.lit(2.0) / F.log2("n")
    small = rows.where(F.col("n") <= SOME)
    pairs = small.alias("a").join(small.select("dir", F.col("node").alias("other")), "dir").where("node < other")
    pairs = pairs.select(F.col("node").alias("src"), F.col("other").alias("dst"), F.when(F.col("n") <= FEW, 2.0).otherwise(damped).alias("weight"))
    hub = F.concat(F.lit("__dir__/"), F.col("dir"))
    stars = rows.where(F.col("n") > SOME).select(F.least("node", hub).alias("src"), F.greatest("node", hub).alias("dst"), damped.alias("weight"))
    return pairs.unionByName(stars)


def add_directory_affinity(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the virtual ones marked, and edges with the affinity added to their weights."""
    near = directory_affinity(nodes)
    out = edges.select("src", "dst", "weight").unionByName(near).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    virtual = near.select(F.explode(F.array("src", "dst")).alias("node")).where(F.startswith("node", F.lit("__dir__/"))).distinct()
    marked = nodes.select("node").distinct().withColumn("is_virtual", F.lit(False)).unionByName(virtual.withColumn("is_virtual", F.lit(True)))
    return marked, out


def strip_virtual(assign: DataFrame, nodes: DataFrame) -> DataFrame:
    """Assignments of files alone: without the ``nodes`` (node, is_virtual) that are marked as virtual (A10)."""
    return assign.join(nodes.where("is_virtual").select("node"), "node", "left_anti").select(assign.columns)


def hub_threshold(edges: DataFrame, nodes: DataFrame, percentile: int = 90, partition: DataFrame | None = None) -> DataFrame:
    """partition, threshold, largest: the degree at place n * percentile // 100 of all nodes (at least 2), and the
    largest degree. Nodes without edges count with degree 0."""
    return _hub_threshold(_degrees_by(_parted(edges, partition)), nodes, percentile, partition)


def _hub_threshold(deg: DataFrame, nodes: DataFrame, percentile: int, partition: DataFrame | None) -> DataFrame:
    own = nodes.select("node").distinct()
    own = own.withColumn("partition", F.lit("__all__")) if partition is None else own.join(partition.select("node", "partition"), "node")
    every = own.join(deg.select("node", "degree"), "node", "left").groupBy("partition", F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count("*").alias("n"))
    picked = _picked(every, "degree", F.floor(F.col("_all") * percentile / 100))
    return picked.select("partition", F.greatest(F.col("degree"), F.lit(2)).alias("threshold")).join(deg.groupBy("partition").agg(F.max("degree").alias("largest")), "partition")


def dampen_hubs(edges: DataFrame, nodes: DataFrame, percentile: int = 90, partition: DataFrame | None = None) -> DataFrame:
    """Weights divided by sqrt(degree / threshold) for each end above the threshold; unchanged where no
    degree exceeds 1 (A11). With ``partition`` each partition has its own degrees and threshold, and edges between
    partitions go."""
    edges = _parted(edges, partition)
    deg = _degrees_by(edges)
    rows = _with_degrees(_facts(edges, _hub_threshold(deg, nodes, percentile, partition), partition), deg)
    factor = F.lit(1.0)
    for end in ("_src", "_dst"):
        factor = factor * F.when(F.col(end) > F.col("threshold"), F.sqrt(F.col(end) / F.col("threshold"))).otherwise(1.0)
    return rows.select("src", "dst", F.when(F.col("largest") <= 1, F.col("weight")).otherwise(F.col("weight") / factor).alias("weight"))


def auto_resolution(nodes: DataFrame, base: float = 1.0, by: str | None = None) -> DataFrame:
    """resolution of each group ``by`` (or of all nodes): ``base`` up to 50 nodes, then growing with their
    log2, at most twice ``base`` (A12)."""
    counts = nodes.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"))
    grown = F.least(base * (1 + 0.5 * F.log2(F.col("n") / 50.0)), F.lit(2.0 * base))
    return counts.withColumn("resolution", F.when(F.col("n") <= 50, base).otherwise(grown))
