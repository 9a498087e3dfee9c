"""Documents as fragments, lookups by q-grams, similarity joins."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from depweave.operators import components, documents, maptables, similar, textbatch
from depweave.plans import registry
from depweave.sources import ledger
from tests.test_queries import SF_DIR
from tests.test_tables import log, tables  # noqa: F401


def text_of(fragments):
    return "\n".join(r.text for r in fragments.orderBy("pos").collect())


def test_map_is_what_the_export_gives(spark, tables, tmp_path):  # noqa: F811
    odd = tables | {
        "modules": tables["modules"].unionByName(spark.createDataFrame([(7, 'no "children"', None)], tables["modules"].schema)),
        "component_files": tables["component_files"].unionByName(spark.createDataFrame([(99, "orphan.py", False)], tables["component_files"].schema)),
        "module_edges": tables["module_edges"].limit(0),
    }
    for given in (tables, odd):
        want = json.loads(maptables.export_map(given).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
        assert json.loads(text_of(documents.map_fragments(given, None))) == want
        documents.write_document(documents.map_fragments(given), str(tmp_path / "map"))
        parts = documents.document_parts(spark, str(tmp_path / "map"))
        whole = "".join(open(p.removeprefix("file:"), encoding="utf-8").read() for p in parts)
        assert json.loads(whole) == {"version": 1, "map": want}


def test_large_modules_stay_in_parts(spark, tables, tmp_path):  # noqa: F811
    """A module with most of the decisions: fragments are small, and the document comes in several parts."""
    many = spark.range(30_000).select(F.col("id").alias("decision_id"), F.lit(1).cast("long").alias("module_id"), F.lit(None).cast("long").alias("component_id"), F.lit("patterns").alias("category"), F.concat(F.lit("rule\n"), "id").alias("text"), F.lit(None).cast("string").alias("detail"), F.lit("human").alias("source"))
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = documents.map_fragments(tables | {"decisions": many})
        assert found.agg(F.max(F.length("text"))).first()[0] < 1000
        documents.write_document(found, str(tmp_path / "map"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held[0])
        spark.conf.set("spark.sql.adaptive.enabled", held[1])
    parts = [open(p.removeprefix("file:"), encoding="utf-8").read() for p in documents.document_parts(spark, str(tmp_path / "map"))]
    assert len(parts) > 4 and max(map(len, parts)) < 0.5 * sum(map(len, parts))
    modules = json.loads("".join(parts))["map"]["modules"]
    assert [d["id"] for d in modules[0]["decisions"]] == list(range(30_000))


def test_requests_by_lines(spark):
    value = lambda c, t: json.dumps({"category": c, "text": t})
    rows = [("decision", 3, "edit", value("api", "old"), value("api", "new")), ("decision", 12, "add", None, value("ui", "a \"b\"")), ("module", 1, "remove", "not json", None), ("decision", 4, "edit", "{}", "[1]")]
    net = log(spark, rows).withColumns({"module_name": F.when(F.col("entity_id") == 3, "Auth"), "component_name": F.when(F.col("entity_id") == 3, "Login").otherwise("")})
    got = [(r.n, r.part, r.line) for r in textbatch.ticket_lines(net).orderBy("n", "part").collect()]
    assert got == [
        (1, 0, '1. EDIT decision on component "Login" (module: Auth)'), (1, 1, "   Was: [api] old"), (1, 2, "   Now: [api] new"),
        (2, 0, '2. EDIT decision on component "unknown component" (module: unknown module)'),
        (3, 0, '3. ADD decision on component "unknown component" (module: unknown module)'), (3, 2, '   Now: [ui] a "b"'),
        (4, 0, '4. REMOVE module on component "unknown component" (module: unknown module)'),
    ]
    assert textbatch.ticket_request(net).first().request.split("\n\n")[0] == "\n".join(x for _, _, x in got[:3])


def test_decisions_by_lines(spark):
    rows = [(1, 5, "b", "one", "x\ny", "human"), (2, 5, " ", "two", None, None), (3, 5, "b", "three", "", "chat"), (4, 6, None, "four", "z", "human")]
    d = spark.createDataFrame(rows, "decision_id long, component_id long, category string, text string, detail string, source string")
    found = documents.decision_lines(d, "component_id")
    bodies = {r.component_id: r.body for r in textbatch.render_decisions(d, "component_id").collect()}
    for owner, body in bodies.items():
        own = sorted(((r.first, -1 if r.id is None else r.id, r.part), r.line) for r in found.where(F.col("component_id") == owner).collect())
        want = [x for x in body.split("\n") if x]
        assert [x for _, x in own if x] == want


def test_requests_by_lines_are_whole(spark):
    """Lines in order of their places are the documents that hold all in one row."""
    rows = [(i, i % 3, ("b", "a", " ")[i % 7 % 3], f"t{i}", "x\ny" if i % 2 else None, ("human", "chat")[i % 5 % 2]) for i in range(30, 0, -1)]
    d = spark.createDataFrame(rows, "decision_id long, component_id long, category string, text string, detail string, source string").withColumn("module_id", F.lit(None).cast("long"))
    c = spark.createDataFrame([(0, 1, "zed"), (1, 1, "abc"), (2, 2, "one")], "component_id long, module_id long, name string")
    f = spark.createDataFrame([(0, "p", False), (0, "p", False), (0, "q", False), (1, "r", False), (2, "s", True)], "component_id long, path string, is_test boolean")

    def joined(lines, *of):
        out = {}
        for r in sorted(lines.collect(), key=lambda r: r.pos):
            own = out.setdefault(tuple(r[x] for x in of), [])
            assert r.pos == len(own) + 1
            own.append(r.line)
        return {k: "\n".join(v) for k, v in out.items()}

    assert joined(documents.decision_lines(d, "component_id"), "component_id") == {(r.component_id,): r.body for r in textbatch.render_decisions(d, "component_id").collect()}
    assert joined(documents.elevation_lines(d, c), "module_id") == {(r.module_id,): r.request for r in textbatch.elevation_requests(d, c).collect()}
    asked = textbatch.validation_requests(c, f, d).collect()
    lines = documents.validation_lines(c, f, d)
    assert joined(lines, "component_id", "human") == {(r.component_id, human): text for r in asked for human, text in ((False, r.pipeline_decisions), (True, r.human_decisions)) if text}
    assert {(r.component_id, r.files) for r in lines.collect()} == {(r.component_id, len(r.files)) for r in asked}


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_names_held_in_texts(spark, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(1, 20))) for _ in range(120)] + ["é/ab", "x"]
    names = sorted({"".join(rng.choice("ab/") for _ in range(rng.randrange(1, 7))) for _ in range(60)} | {"q", "zz", "é/", "abababababababab"})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = components.holders(rows, spark.createDataFrame([(n,) for n in names], "name string"), size)
    assert sorted((r.i, r.name) for r in got.collect()) == sorted((i, n) for i, t in enumerate(texts) for n in names if n in t)
    assert components.holders(rows, spark.createDataFrame([("",)], "name string"), size).collect() == []


@pytest.mark.parametrize("at_least", [0.5, 0.8, 1.0])
def test_similar_sets(spark, at_least):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        base = rows[rng.randrange(len(rows))][2] if rows and rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(1, 12))]
        rows.append((f"p{i % 2}", f"i{i:03d}", [*base[rng.randrange(2) :], rng.choice(words)]))
    rows += [("p0", "none", []), ("p0", "null", [None])]
    sets = {(p, i): {x for x in items if x is not None} for p, i, items in rows}
    want = sorted((p, a, b) for (p, a), (q, b) in itertools.product(sets, repeat=2) if p == q and a < b and sets[p, a] and sets[p, b] and len(sets[p, a] & sets[p, b]) >= at_least * len(sets[p, a] | sets[p, b]) - 1e-9)
    got = similar.similar_sets(spark.createDataFrame(rows, "part string, id string, items array<string>"), at_least)
    assert sorted((r.part, r.a, r.b) for r in got.collect()) == want and want
    for r in got.collect():
        x, y = sets[r.part, r.a], sets[r.part, r.b]
        assert r.common == len(x & y) and abs(r.jaccard - len(x & y) / len(x | y)) < 1e-12


@pytest.mark.parametrize("at_least,block", [(0.1, 7), (0.5, 16), (1.0, 4096)])
def test_linked_sets(spark, at_least, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(700)]
    sets = {f"i{i:03d}": {rng.choice(words[: rng.choice((20, 700))]) for _ in range(rng.randrange(1, 60))} for i in range(150)}
    sets |= {f"j{i:02d}": sets[f"i{i:03d}"] for i in range(40)} | {"all": set(words), "none": set()}
    got = similar.linked_sets(spark.createDataFrame([(i, [*x, *list(x)[:2], None]) for i, x in sets.items()], "id string, items array<string>"), at_least, block).collect()
    near = {i: {j for j, y in sets.items() if j != i and x and y and len(x & y) >= at_least * len(x | y) - 1e-9} for i, x in sets.items()}

    def reached(i):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    assert sorted(map(tuple, got)) == sorted((i, len(near[i]), min(reached(i))) for i, x in sets.items() if x)
    assert any(near.values())


@pytest.mark.parametrize("at_least,block", [(0.1, 7), (0.1, 60), (0.5, 16), (1.0, 4096)])
def test_similar_pairs(spark, at_least, block):
    """Every pair by name, with no shuffle after the pairs of blocks."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(700)]
    sets = {f"i{rng.random()}é": {rng.choice(words[: rng.choice((20, 700))]) for _ in range(rng.randrange(1, 60))} for i in range(120)}
    sets |= {f"j{i:02d}": x for i, x in enumerate([*sets.values()][:40])} | {"all": set(words), "none": set()}
    found = similar.similar_pairs(spark.createDataFrame([(i, [*x, *list(x)[:2], None]) for i, x in sets.items()], "id string, items array<string>"), at_least, block)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    both = {(a, b): (len(x & y), len(x | y)) for (a, x), (b, y) in itertools.product(sets.items(), repeat=2) if a < b and x and y}
    want = sorted((a, b, k, k / n) for (a, b), (k, n) in both.items() if k >= at_least * n - 1e-9)
    assert sorted(map(tuple, found.collect())) == want and want
    assert similar.similar_pairs(found.select(F.col("a").alias("id"), F.array("b").alias("items")).limit(0), at_least, block).collect() == []


def test_similar_texts_names_its_pairs(spark):
    """The result is the pairs, not a count of them."""
    assert registry.QUERIES["similar_texts"](spark, SF_DIR).columns == ["a", "b", "jaccard"]


def test_versions_are_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    assert ledger.versions(spark, path) == []
    assert [ledger.publish(spark.range(n), path) for n in (3, 5)] == [1, 2]
    broken = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        ledger.publish(broken, path)
    assert ledger.versions(spark, path) == [1, 2] and ledger.read(spark, path).count() == 5
    assert ledger.publish(spark.range(7), path) == 3
    assert ledger.read(spark, path).agg(F.max("version"), F.count("*")).first()[:] == (3, 7) and ledger.read(spark, path, 1).count() == 3
