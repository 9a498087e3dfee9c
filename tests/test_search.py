"""Search by trigrams: the same rows as the pattern alone finds, whatever the pattern, batches and keys."""

import random

from pyspark.sql import functions as F

from depweave.operators import maptables, rollup, search
from depweave.sources import scratch

ALPHABET = "aAbB%_ \\\n.é\U0001f600"


def texts_of(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.choice((0, 1, 2, 3, 8, 30)))) for _ in range(n)]


def test_entities_with_and_without_an_index(spark):
    names = texts_of(120, 1)
    modules = spark.createDataFrame([(i, names[i]) for i in range(40)], "module_id long, name string")
    components = spark.createDataFrame([(i, i % 40, names[40 + i]) for i in range(40)], "component_id long, module_id long, name string")
    rows = [(i, i % 40, None, names[80 + i], None if i % 3 == 0 else names[i]) for i in range(40)] + [(None, 1, None, "aab aab", None)]
    decisions = spark.createDataFrame(rows, "decision_id long, module_id long, component_id long, text string, detail string")
    tables = [scratch.cut(t) for t in (modules, components, decisions)]
    indexes = maptables.index_entities(*tables, scratch.new_path(spark, "index"))
    ranked = sorted(n for n in names if len(n) > 8)
    hows = (search.Lookup(few=2), search.Lookup(grams=1, most=3))
    for i, pattern in enumerate(("aab", ranked[7][1:5].upper(), ranked[3][:4] + "%" + ranked[3][5:8], "a_b", "\U0001f600\U0001f600", "B%aab")):
        found, plain = maptables.search_entities(*tables, pattern, indexes, hows[i % 2]), maptables.search_entities(*tables, pattern)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect())), pattern


def test_what_an_index_narrows(spark):
    """Only rows that may match are left, over several batches; repeats and old texts do no harm; an empty batch is one."""
    path = scratch.new_path(spark, "index")
    old = spark.createDataFrame([(i, f"item {i:04d}", i) for i in range(300)], "id long, t string, gram int")
    more = spark.createDataFrame([(7, "renamed", 0), (900, "item 0007 again", 0), (901, None, 0), (902, "it", 0)], old.schema)
    assert [search.add_texts(r, "id", ["t"], path) for r in (old, old.limit(0), more, more)] == [1, 2, 3, 4]
    index = search.read_index(spark, path)
    now = scratch.cut(old.where("id <> 7").unionByName(more))
    left = search.narrowed(now, "id", index, ["0007"])
    assert left.columns == now.columns and {r.id for r in left.collect()} == {7, 900}
    assert {r.id for r in search.narrowed(now, "id", index, ["item", "12"], search.Lookup(few=1)).collect()} == set(range(300)) | {900}
    assert search.narrowed(now, "id", index, ["none such"]).count() == 0
    assert search.may_hold(index, ["it", ""]) is None and search.may_hold(index, ["item"], search.Lookup(most=100)) is None
    assert "gram" in index.where(F.col("gram").isin(["000"]))._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_long_texts_and_labels(spark):
    long = "x" * 300000 + "needle" + "y" * 300000
    nodes = spark.createDataFrame([("a", long), ("b", "x" * 1000), ("c", "Ünïcode LABEL"), (None, "needle")], "node string, label string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "source string, target string")
    path = scratch.new_path(spark, "index")
    search.add_texts(nodes, "node", ["label"], path, F.lower)
    index = search.read_index(spark, path)
    for text in (" NEEDLE ", "ünïc", "xy", "  "):
        got, want = rollup.search_graph(nodes, edges, text, index), rollup.search_graph(nodes, edges, text)
        for x, y in zip(got, want, strict=True):
            assert sorted(map(repr, x.collect())) == sorted(map(repr, y.collect())), text
