"""Edges between components and what is read off edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.operators.search import Lookup, narrowed
from depweave.operators.spread import spread_join
from depweave.sources.scratch import cut


def component_pairs(file_edges: DataFrame, component_files: DataFrame, by: str | None = None) -> DataFrame:
    """low, high, edge_type, cnt between different components; edges with an unknown end are dropped (J4). With ``by``, a
    column of ``component_files``, only pairs in the same ``by``, which is a column of the result too."""
    own = component_files.select(*([by] if by else []), "component", "path")
    rows = every = cut(file_edges.select("src", "dst", "edge_type", "cnt"), "file-edges")
    for end, name, of in (("src", "_a", "_m"), ("dst", "_b", "_n")):  # a file that all others use is dealt over tasks
        rows = spread_join(rows, own.select(F.col("path").alias(end), F.col("component").alias(name), *([F.col(by).alias(of)] if by else [])), end, counted=every.select(end))
    rows = rows.where("_a <> _b and _m = _n" if by else "_a <> _b")
    return rows.groupBy(*([F.col("_m").alias(by)] if by else []), F.least("_a", "_b").alias("low"), F.greatest("_a", "_b").alias("high"), "edge_type").agg(F.sum("cnt").alias("cnt"))


def rollup_edges(file_edges: DataFrame, component_files: DataFrame, by: str | None = None) -> DataFrame:
    """source, target, edge_type, cnt, weight_raw, weight.

    weight_raw is the count over sqrt(files of one * files of the other); weight scales the largest to 10
    with one decimal, 0 if all are 0. Source and target are in name order. ``by`` names a module column of
    ``component_files`` within which components are told apart and scaled."""
    keys = [by] if by else []
    pairs = component_pairs(file_edges, component_files, by)
    sizes = component_files.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    for end, n in (("low", "_n"), ("high", "_m")):
        pairs = pairs.join(sizes.select(*keys, F.col("component").alias(end), F.greatest(F.col("n"), F.lit(1)).alias(n)), [*keys, end])
    pairs = pairs.withColumn("weight_raw", F.col("cnt") / F.sqrt(F.col("_n") * F.col("_m")))
    # The largest weight is one row (one a module); a join keeps the pairs spread over tasks.
    top = pairs.groupBy(*keys).agg(F.max("weight_raw").alias("_top"))
    pairs = pairs.join(top, keys) if by else pairs.join(F.broadcast(top))
    weight = F.when(F.col("_top") > 0, F.round(F.col("weight_raw") * 10 / F.col("_top"), 1)).otherwise(0.0)
    return pairs.select(*keys, F.col("low").alias("source"), F.col("high").alias("target"), "edge_type", "cnt", "weight_raw", weight.alias("weight"))


def refresh_edges(file_edges: DataFrame, component_files: DataFrame, edges: DataFrame) -> DataFrame:
    """Rolled-up edges anew for modules of two components or more; other edges of such modules go, all others
    stay (G10). ``component_files``: module_id, component, path; ``edges``: source, target, edge_type, weight."""
    many = component_files.groupBy("module_id").agg(F.countDistinct("component").alias("k")).where("k >= 2").select("module_id")
    own = component_files.join(many, "module_id", "left_semi")
    fresh = rollup_edges(file_edges, own, by="module_id").select("source", "target", "edge_type", "weight")
    names = own.select("component").distinct()
    kept = edges.select("source", "target", "edge_type", "weight")
    for end in ("source", "target"):
        kept = kept.join(names.withColumnRenamed("component", end), end, "left_anti")
    return fresh.unionByName(kept)


def apply_edge_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` with a label by (source, target, edge_type), '' without one; of several non-blank labels the
    last by ``ord`` (J22)."""
    key = ["source", "target", "edge_type"]
    best = labels.where(F.trim("label") != "").groupBy(*key).agg(F.max_by("label", "ord").alias("label"))
    return edges.drop("label").join(best, key, "left").withColumn("label", F.coalesce("label", F.lit("")))


def filter_edges(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None, min_weight: float = 0.0) -> DataFrame:
    """Edges with both ends among ``nodes``, a type in ``types`` (None: any) and at least the weight."""
    rows = edges.where(F.col("weight") >= min_weight)
    if types is not None:
        rows = rows.where(F.col("edge_type").isin(types))
    ids = nodes.select("node").distinct()
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnRenamed("node", end), end, "left_semi")
    return rows.select(edges.columns)


def search_graph(nodes: DataFrame, edges: DataFrame, text: str, index: DataFrame | None = None, how: Lookup | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes whose label contains the text in any case (all for a blank one), and edges that touch one (W9). ``index``
    (of labels by node, folded by ``lower``) narrows what is checked; what is found is the same."""
    if index is not None:
        nodes = narrowed(nodes, "node", index, [text.strip().lower()], how)
    hits = nodes if not text.strip() else nodes.where(F.contains(F.lower("label"), F.lit(text.strip().lower())))
    ids = hits.select(F.col("node").alias("_id")).distinct()
    touched = edges.join(ids, (F.col("source") == F.col("_id")), "left_semi").unionByName(
        edges.join(ids, F.col("source") == F.col("_id"), "left_anti").join(ids, F.col("target") == F.col("_id"), "left_semi")
    )
    return hits, touched


def incident_edges(edges: DataFrame, node) -> DataFrame:
    """Edges with either end at the node."""
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def module_pair_strength(component_edges: DataFrame, component_module: DataFrame, module_edges: DataFrame) -> DataFrame:
    """low, high, strength of each pair of modules: its cross-module component edges plus the weights of its
    module edges (A22)."""
    own = component_module.select("component", "module")
    rows = component_edges.join(own.select(F.col("component").alias("source"), F.col("module").alias("a")), "source").join(own.select(F.col("component").alias("target"), F.col("module").alias("b")), "target")
    one = rows.where("a <> b").select("a", "b", F.lit(1.0).alias("s"))
    both = one.unionByName(module_edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").cast("double").alias("s")).where("a <> b"))
    return both.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.sum("s").alias("strength"))


def edge_locality(component_edges: DataFrame, component_module: DataFrame) -> DataFrame:
    """module, n_intra, n_cross: edges within each module and across its border, undirected pairs counted once
    (A23)."""
    own = component_module.select("component", "module")
    pairs = component_edges.select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).where("x <> y").distinct()
    rows = pairs.join(own.select(F.col("component").alias("x"), F.col("module").alias("a")), "x").join(own.select(F.col("component").alias("y"), F.col("module").alias("b")), "y")
    ends = rows.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("module"), (F.col("a") == F.col("b")).alias("inside"))
    return ends.groupBy("module").agg(F.count_if("inside").alias("n_intra"), F.count_if(~F.col("inside")).alias("n_cross"))


def node_degrees(edges: DataFrame, distinct_pairs: bool = False) -> DataFrame:
    """node, degree: edge rows at each node, or its distinct undirected pairs."""
    rows = edges.select(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"))
    rows = rows.distinct() if distinct_pairs else rows
    return rows.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def edge_facets(edges: DataFrame) -> DataFrame:
    """One row: edge_types (sorted), min_weight 0 and max_weight, the ceiling of the largest (1 without any)."""
    return edges.agg(F.array_sort(F.collect_set("edge_type")).alias("edge_types"), F.lit(0.0).alias("min_weight"), F.coalesce(F.ceil(F.max("weight")).cast("double"), F.lit(1.0)).alias("max_weight"))


def edge_label_requests(edges: DataFrame, components: DataFrame, by: str = "module_id", top: int = 30) -> DataFrame:
    """A request a module: its components that edges use, by name, and its ``top`` edges by weight, numbered
    (F7). ``edges``: module_id, source, target, edge_type, weight; ``components``: module_id, name, purpose."""
    order = Window.partitionBy(by).orderBy(F.desc("weight"), "source", "target", "edge_type")
    first = edges.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)
    line = F.format_string("%d. %s -> %s (%s, %s)", "rn", "source", "target", "edge_type", F.col("weight").cast("string"))
    lines = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("t")))), lambda x: x["t"]), "\n").alias("edge_lines"))
    used = first.select(by, F.explode(F.array("source", "target")).alias("name")).distinct().join(components, [by, "name"], "left")
    names = used.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("purpose", F.lit(""))))), "\n").alias("component_lines"))
    return lines.join(names, by).select(by, F.concat("component_lines", F.lit("\n\n"), "edge_lines").alias("request"))
