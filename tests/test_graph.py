"""Weights, affinity, noise, hubs, clusters and roll-up on the small graphs of the fixtures."""

import itertools
import random
from math import log2, sqrt

import pytest
from pyspark.sql import functions as F

from depweave.operators import cluster, components, resolution, rollup, weights
from depweave.operators.spread import spread_join

EDGES = "src string, dst string, edge_type string, cnt long"


def edges_of(spark, rows):
    return spark.createDataFrame(rows, EDGES)


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def weighted(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


OCC = "index_id string, doc_ord long, occ_ord long, relative_path string, symbol string, symbol_roles int"


def test_resolution_rules(spark):
    occ = spark.createDataFrame(
        [("i", 0, 0, "a.py", "S", 1), ("i", 1, 0, "b.py", "S", 0), ("i", 1, 1, "b.py", "S", 2), ("i", 2, 0, "c.py", "S", 1), ("i", 0, 1, "a.py", "S", 0), ("j", 0, 0, "d.py", "S", 0), ("i", 1, 2, "b.py", "local 1", 0), ("i", 1, 3, "b.py", "", 0), ("i", 1, 4, "b.py", "gone", 0), ("i", 3, 0, "e.py", "f().", 1), ("i", 1, 5, "b.py", "f().", 0)],
        OCC,
    )
    sym = spark.createDataFrame([("i", 0, 0, "a.py", "S", 7), ("i", 1, 0, "c.py", "S", 0)], "index_id string, doc_ord long, sym_ord long, relative_path string, symbol string, kind int")
    # The later definition wins; an import role is no definition; another index never resolves here.
    assert {(r.src, r.dst, r.edge_type): r.cnt for r in resolution.file_edges(occ, sym).collect()} == {("b.py", "c.py", "import"): 2, ("a.py", "c.py", "import"): 1, ("b.py", "e.py", "import"): 1, ("b.py", "e.py", "call"): 1}
    files = spark.createDataFrame([("b.py",), ("c.py",)], "path string")
    assert {(r.src, r.dst) for r in resolution.file_edges(occ, sym, files=files).collect()} == {("b.py", "c.py")}
    rel = spark.createDataFrame([("i", "b.py", "T", "S", True), ("i", "b.py", "T", "S", False), ("i", "c.py", "U", "S", True)], "index_id string, relative_path string, symbol string, target_symbol string, is_implementation boolean")
    assert [(r.path, r.def_path, r.cnt) for r in resolution.resolve_inheritance(rel, occ).collect()] == [("b.py", "c.py", 1)]


@pytest.mark.parametrize("rows,expected", [([("a", "b", "call", 1)], 1.0), ([("a", "b", "call", 100)], log2(101)), ([("a", "b", "call", 3), ("a", "b", "import", 2), ("a", "b", "inheritance", 1)], 2 + 0.3 * log2(3) + 0.5)])
def test_combined_weight(spark, rows, expected):
    assert weights.combine_weights(edges_of(spark, rows), nodes_of(spark, "ab")).first().weight == pytest.approx(expected)


def test_affinity_sizes(spark):
    def count(n, prefix="d"):
        nodes = nodes_of(spark, [f"{prefix}/f{i}.py" for i in range(n)])
        marked, edges = weights.add_directory_affinity(nodes, weighted(spark, []))
        return edges, edges.count(), marked.where("is_virtual").count()

    assert count(1)[1:] == (0, 0) and count(5)[1:] == (10, 0) and count(10)[1:] == (45, 0)
    assert count(11)[1:] == (11, 1) and count(100)[1:] == (100, 1)
    assert count(64)[0].first().weight == pytest.approx(2 / log2(64))
    assert count(4)[0].first().weight == 2.0
    both = nodes_of(spark, [f"a/f{i}" for i in range(3)] + [f"b/f{i}" for i in range(20)])
    assert weights.add_directory_affinity(both, weighted(spark, [("a/f0", "a/f1", 1.0)]))[1].count() == 23


def test_average_degree_is_of_nodes_with_edges(spark):
    assert weights.average_degree(weighted(spark, [("a", "b", 1.0)])).first().avg_degree == 1.0
    assert weights.average_degree(weighted(spark, [("a", "b", 1.0), ("b", "c", 1.0)])).first().avg_degree == pytest.approx(4 / 3)
    assert weights.average_degree(weighted(spark, [])).first().avg_degree == 0.0


def test_noise_gate(spark):
    e = weighted(spark, [("hub", f"n{i}", 3.0) for i in range(6)] + [("n0", "n1", 0.1)])
    assert weights.drop_noise(e).count() == 7
    assert weights.drop_noise(e, sparse_degree_threshold=0).count() == 7


def test_weak_edge_goes_when_the_gate_is_open(spark):
    e = weighted(spark, [("a", "b", 5.0), ("b", "c", 5.0), ("c", "d", 0.3), ("d", "e", 5.0)])
    assert weights.drop_noise(e).count() == 4
    assert ("c", "d") not in {(r.src, r.dst) for r in weights.drop_noise(e, sparse_degree_threshold=0).collect()}


def test_partitions_have_their_own_gate_and_hubs(spark):
    """A dense partition loses its weak edge, a sparse one keeps its own; edges between them go."""
    dense = [(f"d{i}", f"d{j}", 0.3 if (i, j) == (0, 1) else 2.0) for i, j in itertools.combinations(range(8), 2)]
    e = weighted(spark, [*dense, ("s0", "s1", 0.3), ("s1", "s2", 2.0), ("d0", "s0", 9.0)])
    part = spark.createDataFrame([(f"d{i}", "d") for i in range(8)] + [(f"s{i}", "s") for i in range(4)], "node string, partition string")
    left = {(r.src, r.dst) for r in weights.drop_noise(e, part).collect()}
    assert left == {(a, b) for a, b, w in dense if w > 1} | {("s0", "s1"), ("s1", "s2")}
    facts = {r.partition: (r.threshold, r.largest) for r in weights.hub_threshold(e, part, 90, part).collect()}
    assert facts == {"d": (7, 7), "s": (2, 2)}
    star = [("hub", f"n{i}", 1.0) for i in range(9)]
    two = weighted(spark, [*star, ("x", "y", 1.0)])
    own = spark.createDataFrame([(n, "star") for n in ["hub", *(f"n{i}" for i in range(9))]] + [("x", "pair"), ("y", "pair")], "node string, partition string")
    out = {(r.src, r.dst): r.weight for r in weights.dampen_hubs(two, own, partition=own).collect()}
    assert out[("x", "y")] == 1.0 and out[("hub", "n0")] == 1.0  # the threshold is the hub's own degree
    assert {round(r.weight, 9) for r in weights.dampen_hubs(two, own).where("src = 'hub'").collect()} == {round(1 / sqrt(9 / 2), 9)}


def test_virtual_nodes_go_by_their_mark(spark):
    assign = spark.createDataFrame([("a", 0), ("__dir__/x", 0), ("__dir__/real.py", 1)], "node string, cluster int")
    nodes = spark.createDataFrame([("a", False), ("__dir__/x", True), ("__dir__/real.py", False)], "node string, is_virtual boolean")
    assert {r.node for r in weights.strip_virtual(assign, nodes).collect()} == {"a", "__dir__/real.py"}


def test_hot_keys_join_the_same(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(900)] + [(7, "hot")] * 40, "i long, k string").repartition(5)
    table = spark.createDataFrame([("hot", 1), ("k6", 2), ("k0", 3), ("none", 4)], "k string, count int")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(table, "k", how).collect()))
        for kw in ({"part_rows": 10}, {"part_rows": 10, "most_hot": 2}, {}, {"part_rows": 10, "hint": "shuffle_hash"}, {"part_rows": 10, "counted": rows.select("k")}):
            out = spread_join(rows, table, "k", how, **kw)
            assert out.columns == rows.join(table, "k", how).columns and sorted(map(str, out.collect())) == want


def test_hubs(spark):
    names = [f"n{i:02d}" for i in range(30)]
    e = weighted(spark, [("hub", n, 1.0) for n in names])
    out = weights.dampen_hubs(e, nodes_of(spark, ["hub", *names])).collect()
    assert {round(r.weight, 9) for r in out} == {round(1 / sqrt(30 / 2), 9)}
    assert weights.dampen_hubs(weighted(spark, [("a", "b", 1.0)]), nodes_of(spark, "ab")).first().weight == 1.0


def planted(groups, size, inner=5.0, outer=0.5):
    rows = [(f"g{g}/f{i:02d}", f"g{g}/f{j:02d}", inner) for g in range(groups) for i, j in itertools.combinations(range(size), 2)]
    return rows + [(f"g{g}/f00", f"g{g + 1}/f00", outer) for g in range(groups - 1)]


def test_planted_communities(spark):
    rows = planted(4, 6)
    names = sorted({x for r in rows for x in r[:2]} | {"alone"})
    found = cluster.communities(weighted(spark, rows), nodes_of(spark, names), 1.0).collect()
    by = {}
    for r in found:
        by.setdefault(r.cluster, set()).add(r.node)
    assert len(found) == len(names)
    assert sorted(map(sorted, by.values())) == sorted([sorted({f"g{g}/f{i:02d}" for i in range(6)}) for g in range(4)] + [["alone"]])


def test_targets(spark):
    rows = planted(3, 5)
    names = sorted({x for r in rows for x in r[:2]})
    e, n = weighted(spark, rows), nodes_of(spark, names)
    assert {r.cluster for r in cluster.communities_targeted(e, n, 1).collect()} == {0}
    found = cluster.communities_targeted(e, n, 3).collect()
    assert len(found) == len(names) and abs(len({r.cluster for r in found}) - 3) <= 2


def test_partitions_search_apart(spark):
    """Two partitions at once, with targets of their own, give what each gives alone; edges between them don't count."""
    rows = planted(4, 5)
    names = sorted({x for r in rows for x in r[:2]})
    part = spark.createDataFrame([(n, n[:2] < "g2") for n in names], "node string, p boolean").select("node", F.when(F.col("p"), "one").otherwise("two").alias("partition"))
    found = cluster.communities(weighted(spark, rows), nodes_of(spark, names), 1.0, part).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.partition, r.cluster), set()).add(r.node[:2])
    assert groups == {("one", 0): {"g0"}, ("one", 1): {"g1"}, ("two", 0): {"g2"}, ("two", 1): {"g3"}}
    targets = spark.createDataFrame([("one", 1), ("two", 2)], "partition string, target int")
    both = cluster.communities_targeted(weighted(spark, rows), nodes_of(spark, names), targets, part)
    assert {r.partition: r.n for r in both.groupBy("partition").agg(F.countDistinct("cluster").alias("n")).collect()}["one"] == 1
    assert both.count() == 20


def test_target_sizes(spark):
    n = spark.createDataFrame([(0,), (2999,), (4000,), (90000,)], "n long")
    assert [r[0] for r in n.select(cluster.target_components("n")).collect()] == [3, 3, 4, 25]
    part = spark.createDataFrame([(str(i), "a" if i < 30 else "b") for i in range(40)], "node string, partition string")
    assert {r.partition: (r.n, r.target) for r in cluster.partition_targets(part, 10).collect()} == {"a": (30, 7), "b": (10, 2)}


def test_communities_do_not_depend_on_partitions(spark):
    rng = random.Random(11)
    rows = [(*sorted((f"n{a:03d}", f"n{b:03d}")), rng.random() + (2 if a // 10 == b // 10 else 0)) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(700)) if a != b]
    nodes = nodes_of(spark, [f"n{i:03d}" for i in range(121)])
    runs = [sorted(map(tuple, cluster.communities(weighted(spark, rows).repartition(k), nodes.repartition(k), how=cluster.Search(levels=3, rounds=8, last=8)).collect())) for k in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 121
    q = cluster.modularity(weighted(spark, rows), spark.createDataFrame(runs[0], "node string, cluster int")).first().q
    assert q > 0.3


def test_components_and_modularity(spark):
    e = weighted(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 2.0)])
    got = {r.node: r.component for r in cluster.connected_components(e, nodes_of(spark, "abcxyz")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    two = spark.createDataFrame([(n, 0 if n in "abc" else 1) for n in "abcxy"], "node string, cluster int")
    assert cluster.modularity(e, two).first().q == pytest.approx(0.5)
    assert cluster.modularity(e, two.withColumn("cluster", two.cluster * 0)).first().q == 0.0
    assert cluster.modularity(weighted(spark, []), two).first().q == 0.0


@pytest.mark.parametrize(
    "names,kw,sizes",
    [
        ([f"app{a}/x/f{i}.py" for a in range(5) for i in range(6)], {}, [6] * 5),
        ([f"pkg{a}/x/f{i}.py" for a in range(4) for i in range(10)], {}, [10] * 4),
        ([f"f{i}.py" for i in range(10)], {}, [10]),
        ([f"a/b{k}/f{i}" for k in range(3) for i in range(3)], {"min_size": 3}, [3, 3, 3]),
        ([f"a/b{k}/f{i}" for k in range(3) for i in range(3)], {"min_size": 5}, [9]),
        (["a/x/1", "a/x/2", "a/x/3", "b/y/1", "b/y/2"], {"min_size": 2}, [2, 3]),
        ([f"app{a}/x/f{i}.py" for a in range(5) for i in range(6)] + ["z/q/1", "z/r/1"], {}, [6, 6, 6, 6, 8]),
        ([f"app{a}/x/f{i}.py" for a in range(5) for i in range(6)], {"target": 3}, [30]),
    ],
)
def test_partitions(spark, names, kw, sizes):
    rows = cluster.partition_nodes(nodes_of(spark, names), **kw).groupBy("partition").count().collect()
    assert sorted(r["count"] for r in rows) == sizes


FILES = {"Billing": ["shop/pay/charge.py", "shop/pay/refund.py"], "Ledger": ["shop/books/entry.py", "shop/books/report.py"], "Text": ["shop/text/format.py"]}


def files_of(spark, files=None):
    return spark.createDataFrame([(c, p) for c, ps in (files or FILES).items() for p in ps], "component string, path string")


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([("shop/books/entry.py", "shop/pay/charge.py", "call", 7)], [("Billing", "Ledger", "call", 10.0)]),
        ([("shop/pay/charge.py", "shop/pay/refund.py", "call", 2)], []),
        ([("shop/books/entry.py", "shop/pay/charge.py", "call", 8), ("shop/books/report.py", "shop/pay/charge.py", "import", 2)], [("Billing", "Ledger", "call", 10.0), ("Billing", "Ledger", "import", 2.5)]),
        ([("shop/books/entry.py", "shop/pay/charge.py", "call", 3), ("shop/pay/charge.py", "shop/text/format.py", "call", 6)], [("Billing", "Ledger", "call", 3.5), ("Billing", "Text", "call", 10.0)]),
        ([("elsewhere.py", "shop/pay/charge.py", "call", 1)], []),
    ],
)
def test_rollup(spark, rows, expected):
    got = rollup.rollup_edges(edges_of(spark, rows), files_of(spark)).collect()
    assert sorted((r.source, r.target, r.edge_type, r.weight) for r in got) == expected


def test_rollup_by_size(spark):
    files = {"Big": [f"b{i}" for i in range(25)], "Medium": ["m0", "m1"], "Small": ["s"]}
    got = {(r.source, r.target): r.weight for r in rollup.rollup_edges(edges_of(spark, [("b0", "s", "call", 5), ("m0", "s", "call", 5)]), files_of(spark, files)).collect()}
    assert got[("Medium", "Small")] > got[("Big", "Small")]


def test_names(spark):
    rows = [("a/core/x.py", 0), ("a/core/y.py", 0), ("b/core/z.py", 1), ("top.py", 2), ("b/core/w.py", 3), ("core/v.py", 4), ("only/u.py", 5)]
    got = {r.cluster: r.name for r in components.name_clusters(spark.createDataFrame(rows, "node string, cluster int")).collect()}
    assert got == {0: "a/core", 1: "b/core_1", 3: "b/core_2", 2: "root", 4: "root/core", 5: "only"}


def test_same_names_merge(spark):
    c = spark.createDataFrame([(0, "A ", "one", 0.5), (1, "A", "two", 0.9), (2, "A", "one", 0.1), (3, "B", None, 0.4)], "ord int, name string, purpose string, confidence double")
    f = spark.createDataFrame([("A ", "x"), ("A", "y"), ("A", "x"), ("B", "z")], "name string, path string")
    merged, files = components.merge_same_name(c, f)
    assert sorted((r.name, r.purpose, r.confidence) for r in merged.collect()) == [("A", "one; two", 0.9), ("B", "", 0.4)]
    assert sorted(map(tuple, files.collect())) == [("A", "x"), ("A", "y"), ("B", "z")]


def test_redistribution(spark):
    assign = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "node string, cluster int")
    calls = spark.createDataFrame([("a", "c", 6), ("a", "b", 1), ("b", "d", 1), ("a", "d", 3)], "src string, dst string, cnt long")
    assert {r.node: r.cluster for r in cluster.redistribute(assign, calls).collect()} == {"a": 1, "b": 0, "c": 0, "d": 0}


def test_assign_tests_chain(spark):
    own = files_of(spark, FILES | {"Deep": ["shop/very/long/sub/path/a.py", "shop/very/long/sub/path/b.py"]})
    calls = spark.createDataFrame([("shop/pay/charge.py", "tests/test_x.py", 3), ("shop/books/report.py", "tests/test_x.py", 1)], "src string, dst string, cnt long")
    cases = {
        "tests/test_x.py": ("Billing", "calls"),
        "tests/test_report.py": ("Ledger", "name"),
        "tests/test_efund.py": ("Billing", "name"),  # within a word
        "tests/test_very_long_sub_path.py": ("Deep", "name"),  # four words as a path
        "tests/test_very_zzz.py": ("Deep", "name"),  # the first word
        "tests/test_zzz.py": ("unassigned", "unassigned"),
        "TEXT/tests/y.py": ("unassigned", "unassigned"),
        "TEXT/y_test.py": ("Text", "name"),  # the folder, in any case
        "tests/report.py": ("unassigned", "unassigned"),
        "test_.py": ("unassigned", "unassigned"),
    }
    tests = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: (r.component, r.how) for r in components.assign_tests(tests, calls, own).collect()} == cases


def test_new_tests_follow_the_first_source(spark):
    sources = spark.createDataFrame([("a/z.py", "Z"), ("a/b/c.py", "C"), ("root.py", "R")], "path string, component string")
    known = spark.createDataFrame([("Help_Desk",), ("C",)], "component string")
    cases = {"a/b/test_c.py": "C", "a/b/d/test_q.py": "C", "a/x/test_y.py": "Z", "test_r.py": "R", "q/helpdesk/test_s.py": "Help_Desk", "q/none/test_t.py": None}
    tests = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.component for r in components.assign_new_tests(tests, sources, known).collect()} == {k: v for k, v in cases.items() if v}
    # Of sources in the same and in an upper directory the first by path counts, not the nearest.
    two = spark.createDataFrame([("a/z.py", "Z"), ("a/b/zz.py", "C"), ("a/a.py", "A")], "path string, component string")
    assert components.assign_new_tests(spark.createDataFrame([("a/b/test_c.py",)], "path string"), two, known).first().component == "A"


RESPONSES = "cluster int, ok boolean, should_split boolean, confidence double, primary_responsibility string, part_ord int, name string, purpose string"


def test_components_from_responses(spark):
    clusters = spark.createDataFrame([(i, f"own{i}") for i in range(6)], "cluster int, name string")
    rows = [
        (0, True, True, 0.9, "all", 0, "A", "a"), (0, True, True, 0.9, "all", 1, "B", None),
        (1, True, False, 0.8, "all", 0, "C", None), (1, True, False, 0.8, "all", 1, "D", "d"),
        (2, True, None, 0.9, "why", None, None, None), (3, True, True, None, None, 0, "E", "e"), (4, False, None, 0.9, None, None, None, None),
    ]
    got = sorted((r.cluster, r.ord, r.name, r.purpose, r.confidence) for r in components.components_from_responses(clusters, spark.createDataFrame(rows, RESPONSES)).collect())
    assert got == [(0, 0, "A", "a", 0.9), (0, 1, "B", "", 0.9), (1, 0, "C", "all", 0.8), (2, 0, "own2", "why", 0.9), (3, 0, "E", "e", 0.7), (4, 0, "own4", "", 0.3), (5, 0, "own5", "", 0.3)]
    conf = spark.createDataFrame([("a", 0.4), ("b", 0.0), ("c", None), ("d", 0.5)], "name string, confidence double")
    assert [r.name for r in components.low_confidence(conf).collect()] == ["a"]


def test_split_responses_and_profiles(spark):
    clusters = spark.createDataFrame([(0, "x"), (0, "y"), (0, "z"), (1, "q")], "cluster int, path string")
    parts = spark.createDataFrame([(0, 0, "First", "x"), (0, 1, "Second", "y"), (0, 1, "Second", "q"), (0, 2, "Third", "x"), (0, 3, "Empty", None)], "cluster int, part_ord int, name string, path string")
    assert sorted(map(tuple, components.apply_split_responses(clusters, parts).collect())) == [(0, "First", "x"), (0, "First", "z"), (0, "Second", "y")]
    assign = spark.createDataFrame([("a/1", 0), ("a/2", 0), ("b/3", 0), ("b/4", 1)], "node string, cluster int")
    calls = spark.createDataFrame([("a/1", "a/2", 3), ("a/1", "b/3", 5), ("b/3", "b/4", 9)], "src string, dst string, cnt long")
    dirs, inner = components.cluster_profile(assign, calls, top=1)
    assert sorted((r.cluster, r.dir, r.n) for r in dirs.collect()) == [(0, "a", 2), (1, "b", 1)]
    assert [(r.cluster, r.src, r.dst, r.cnt) for r in inner.collect()] == [(0, "a/1", "b/3", 5)]


def discovered(spark, **kw):
    occ = []
    for g in range(3):
        for i in range(6):
            occ.append(("i", g * 6 + i, 0, f"app{g}/core/f{i}.py", f"s{g}{i}().", 1))
            occ += [("i", g * 6 + i, 1 + j, f"app{g}/core/f{i}.py", f"s{g}{j}().", 0) for j in range(6) if j != i]
    occ += [("i", 50, 0, "app0/tests/test_f1.py", "s01().", 0), ("i", 5, 9, "app0/core/f5.py", "s10().", 0)]
    s = spark.createDataFrame([("i", 0, 0, "app0/core/f0.py", "s00().", 17)], "index_id string, doc_ord long, sym_ord long, relative_path string, symbol string, kind int")
    return components.discover(spark.createDataFrame(occ, OCC), s, **kw)


def test_discovery_end_to_end(spark):
    out = discovered(spark)
    files = out["component_files"].collect()
    assert len(files) == 19 and {r.component for r in files} == {"app0/core", "app1/core", "app2/core"}
    assert [r.component for r in files if r.is_test] == ["app0/core"]
    assert [(r.source, r.target, r.edge_type, r.cnt) for r in out["component_edges"].orderBy("edge_type").collect()] == [("app0/core", "app1/core", "call", 1), ("app0/core", "app1/core", "import", 1)]
    assert {(r.name, r.confidence) for r in out["components"].collect()} == {(f"app{g}/core", 0.3) for g in range(3)}
    assert out["metadata"].count() == 18 and out["metadata"].where("size(exports) > 0").first().exports == ["s00()"]
    assert {(r.dir, r.n) for r in out["directories"].collect()} == {(f"app{g}/core", 6) for g in range(3)} and out["calls"].count() == 30


def test_discovery_with_responses(spark, monkeypatch):
    """One cluster is split, one renamed to the name of another, files move, and edges get labels. Every partition is a
    cluster here."""
    whole = lambda graph, nodes, targets, part: part.select("node", "partition", F.lit(0).alias("cluster"))
    monkeypatch.setattr(cluster, "communities_targeted", whole)
    names = {r.name: r.cluster for r in discovered(spark)["clusters"].select("name", "cluster").distinct().collect()}
    zero, one, two = (names[f"app{g}/core"] for g in range(3))
    rows = [
        (zero, True, True, 0.9, "", 0, "Low", "first", ["app0/core/f0.py", "app0/core/f1.py", "nowhere.py"]), (zero, True, True, 0.9, "", 1, "High", "second", ["app0/core/f5.py"]),
        (one, True, False, 0.8, "does x", 0, "Same", None, None), (two, True, False, None, "does y", 0, "Same ", None, None),
    ]
    responses = spark.createDataFrame(rows, components.RESPONSES)
    moves = spark.createDataFrame([("app0/core/f1.py", "High", 0.9), ("app0/core/f2.py", "Unknown", 0.9)], "path string, target string, confidence double")
    labels = spark.createDataFrame([("High", "Same", "call", 0, "asks")], "source string, target string, edge_type string, ord int, label string")
    out = discovered(spark, responses=responses, suggestions=moves, labels=labels)
    files = {r.path: r.component for r in out["component_files"].where("not is_test").collect()}
    assert files["app0/core/f5.py"] == files["app0/core/f1.py"] == "High"
    assert {files[f"app0/core/f{i}.py"] for i in (0, 2, 3, 4)} == {"Low"} and {files[f"app{g}/core/f{i}.py"] for g in (1, 2) for i in range(6)} == {"Same"}
    assert {(r.name, r.purpose, r.confidence) for r in out["components"].collect()} == {("Low", "first", 0.9), ("High", "second", 0.9), ("Same", "does x; does y", 0.8)}
    edges = {(r.source, r.target, r.edge_type): r.label for r in out["component_edges"].collect()}
    assert edges[("High", "Same", "call")] == "asks" and edges[("High", "Same", "import")] == ""


def test_components_of_many_names_go_by_numbers(spark, monkeypatch):
    """More names than ``small``: only numbers are written in rounds, and the result has the names again."""
    names = [f"n{i:02d}" for i in range(40)]
    edges = [(names[i], names[j], 1.0) for i, j in ((3, 9), (9, 1), (20, 30), (30, 21), (21, 3), (7, 8), (38, 39))]
    written, cut = [], cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda df, name="step": written.append((name, dict(df.dtypes))) or cut(df, name))
    rows = spark.createDataFrame(edges, "src string, dst string, weight double")
    runs = [sorted(map(tuple, cluster.connected_components(rows, nodes_of(spark, names), small=small).collect())) for small in (100, 2, 0)]
    assert runs[0] == runs[1] == runs[2] and ("n39", "n38") in runs[0] and ("n20", "n01") in runs[0] and ("n00", "n00") in runs[0]
    assert all(kinds["up"] == "bigint" for name, kinds in written[written.index(("names", {"node": "string", "id": "bigint"})) :] if name == "up")


def test_weights_take_one_shuffle(spark):
    rows = [("a", "b", "import", 3), ("a", "b", "import", 4), ("a", "b", "call", 1), ("a", "c", "other", 5), ("b", "c", "inheritance", 3)]
    out = weights.combine_weights(spark.createDataFrame(rows, "src string, dst string, edge_type string, cnt long"))
    assert {(r.src, r.dst): round(r.weight, 9) for r in out.collect()} == {("a", "b"): 1.9, ("a", "c"): 0.0, ("b", "c"): 1.0}
    assert out._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2
