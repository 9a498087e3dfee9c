"""Queries that SQL is too slow for or can't express: brute force over whole tables, and the bounds of searches."""

from pyspark.sql import functions as F

from depweave.operators import cluster
from depweave.plans import registry
from tests.test_queries import SF_DIR, duck, pytestmark  # noqa: F401

def test_components_of_all_edges(spark, duck):  # noqa: F811
    """Every file is there, and edges of any weight join: against a union-find over all line items."""
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    path = "p_brand || '/' || p_type || '/p' || p_partkey || '.py'"
    lines = duck.execute(f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {path} FROM lineitem JOIN part ON l_partkey = p_partkey ORDER BY 1, 2, 3, 4").fetchall()
    defined = {order: file for order, line, _, _, file in lines if line == 1}
    for order, line, _, _, file in lines:
        ends = sorted((root(file), root(defined.get(order, file) if line != 1 else file)))
        of[ends[1]] = ends[0]
    got = {r.node: r.component for r in registry.QUERIES["connected_components"](spark, SF_DIR).collect()}
    assert got == {file: root(file) for file in list(of)}


def test_targeted_sweep_takes_five_rounds(spark, monkeypatch):
    """As long as there are too many communities, the query halves five times; each search has its full bounds, and all
    but the first begin with what the one before found."""
    tried = []
    nodes = spark.range(100).select(F.col("id").cast("string").alias("name"), F.lit("__all__").alias("partition"), "id").withColumnRenamed("id", "node")

    def each_alone(graph, part, gammas, start, how, turns):
        tried.append((round(gammas.first().gamma, 3), start is not None, how))
        return part.select("node", F.col("node").alias("comm"))

    monkeypatch.setattr(cluster, "_search", each_alone)
    monkeypatch.setattr(cluster, "_numbered_graph", lambda edges, own, partition: (nodes, nodes.select("node")))
    monkeypatch.setattr(cluster, "_finished", lambda graph, part, comm, how: part.select(F.col("name").alias("node"), "partition", F.lit(0).alias("cluster")))
    monkeypatch.setattr(registry, "_weighted", lambda spark, sf: None)
    monkeypatch.setattr(registry, "_nodes", lambda spark, sf: nodes.select(F.col("name").alias("node")))
    registry.QUERIES["communities_targeted"](spark, SF_DIR)
    assert tried == [(gamma, gamma < 5, cluster.STEP) for gamma in (5.005, 2.507, 1.259, 0.634, 0.322)]
