"""Change log, versions, map tables, text batches, sources, checks and diagnostics on small tables."""

import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from depweave.operators import changes, checks, diagnostics, maptables, resolution, rollup, textbatch, versions
from depweave.sources import languages, readers
from depweave.streaming import collapse

LOG = "ord long, entity_type string, entity_id long, action string, old_value string, new_value string, module_id long"


def log(spark, rows):
    return spark.createDataFrame([(i, kind, key, action, old, new, 100 + i) for i, (kind, key, action, old, new) in enumerate(rows)], LOG)


V = [json.dumps({"text": f"v{i}"}) for i in range(5)]
RECORDS = {
    "one add": ([("add", None, V[1])], ("add", None, V[1])),
    "add remove": ([("add", None, V[1]), ("remove", V[1], None)], None),
    "add edit": ([("add", None, V[1]), ("edit", V[1], V[2])], ("add", None, V[2])),
    "edit remove": ([("edit", V[1], V[2]), ("remove", V[2], None)], ("remove", V[1], None)),
    "edits": ([("edit", V[1], V[2]), ("edit", V[2], V[3]), ("edit", V[3], V[4])], ("edit", V[1], V[4])),
    "there and back": ([("edit", V[1], V[2]), ("edit", V[2], '{ "text":"v1" }')], None),
    "all": ([("add", None, V[1]), ("edit", V[1], V[2]), ("edit", V[2], V[3]), ("remove", V[3], None)], None),
}


def test_net_delta_of_every_kind(spark):
    rows = [("decision", k, *r) for k, (records, _) in enumerate(RECORDS.values()) for r in records] + [("module", 0, "edit", V[1], V[2])]
    got = {(r.entity_type, r.entity_id): (r.action, r.old_value, r.new_value) for r in changes.collapse_changes(log(spark, rows)).collect()}
    want = {("decision", k): net for k, (_, net) in enumerate(RECORDS.values()) if net} | {("module", 0): ("edit", V[1], V[2])}
    assert got == want
    mixed = changes.collapse_changes(log(spark, rows).withColumn("k", F.col("entity_id")), key_cols=("entity_id",))
    assert mixed.where("entity_id = 0").count() == 1
    assert changes.collapse_changes(log(spark, [])).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    rows = [("decision", k, *r) for k, (records, _) in enumerate(RECORDS.values()) for r in records]
    df = log(spark, rows)
    first, second = df.where("ord >= 8").cache(), df.where("ord < 8")  # the later records come first
    first.repartition(3).write.parquet(str(tmp_path / "log"))
    place = (str(tmp_path / "log"), df.schema, str(tmp_path / "state"))
    net = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    assert net(collapse.stream_collapse(spark, *place, files_per_batch=1)) == net(changes.collapse_changes(first))
    second.write.mode("append").parquet(str(tmp_path / "log"))
    assert net(collapse.stream_collapse(spark, *place, files_per_batch=1, compact_after=1)) == net(changes.collapse_changes(df))
    # What was folded is deleted, and nothing changes without new files.
    assert not list((tmp_path / "state").glob("changed-*")) and len(list((tmp_path / "state").glob("folded-*"))) == 1
    assert net(collapse.stream_collapse(spark, *place)) == net(changes.collapse_changes(df))


def test_stream_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    """A batch that dies after it has put out its rows, but before it is committed, is taken in again, once."""
    rows = [("decision", k, *r) for k, (records, _) in enumerate(RECORDS.values()) for r in records]
    df = log(spark, rows)
    df.repartition(5).write.parquet(str(tmp_path / "log"))
    place = (str(tmp_path / "log"), df.schema, str(tmp_path / "state"))
    whole, ran = DataFrameWriter.parquet, []

    def dies(self, path, *a, **kw):
        whole(self, path, *a, **kw)
        ran.append(path)
        if path.endswith("changed-2"):
            raise RuntimeError("killed")

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="killed"):
        collapse.stream_collapse(spark, *place, files_per_batch=1)
    monkeypatch.setattr(DataFrameWriter, "parquet", whole)
    assert collapse.last_batch(spark, f"{place[2]}/progress") == 1
    uncommitted = collapse.current_state(spark, place[2], df.schema, ("entity_type", "entity_id"), ("ord",))
    assert uncommitted.agg(F.sum("n")).first()[0] < df.count()
    net = collapse.stream_collapse(spark, *place, files_per_batch=1)
    assert sorted(map(tuple, net.collect()), key=str) == sorted(map(tuple, changes.collapse_changes(df).collect()), key=str)


def test_stream_counts_repeated_records_once(spark, tmp_path):
    rows = [("decision", k, *r) for k, (records, _) in enumerate(RECORDS.values()) for r in records]
    df = log(spark, rows).withColumn("ts", F.timestamp_seconds(946684800 + F.col("ord") * 60))
    df.unionByName(df.where("ord % 2 = 0")).repartition(4).write.parquet(str(tmp_path / "log"))
    net = collapse.stream_collapse(spark, str(tmp_path / "log"), df.schema, str(tmp_path / "state"), files_per_batch=1, event_time="ts", delay="1 day")
    assert sorted(map(tuple, net.collect()), key=str) == sorted(map(tuple, changes.collapse_changes(df).collect()), key=str)


def test_baselines(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "ord long, baseline_id long")
    base = spark.createDataFrame([(5, "t")], "baseline_id long, created_at string")
    assert changes.changes_since(rows, base).count() == 1
    assert changes.changes_since(rows, base.limit(0)).count() == 2
    assert [r.baseline_id for r in changes.new_baseline(base, "u").orderBy("baseline_id").collect()] == [5, 6]
    assert changes.current_baseline(changes.new_baseline(base.limit(0), "u")).first() == (1, "u")


DECISIONS = "decision_id long, module_id long, component_id long, category string, text string, detail string, source string"


@pytest.fixture(scope="module")
def tables(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "modules": t([(1, "Auth Service", "module"), (2, "Shared Utils", "shared-library")], "module_id long, name string, classification string"),
        "module_directories": t([(1, "src/auth"), (1, "src/auth/handlers"), (2, "src/utils")], "module_id long, directory string"),
        "components": t([(1, 1, "Login Handler", "logs in", 0.9), (2, 1, "Token Manager", None, 0.85), (3, 2, "String Helpers", "", 0.95)], "component_id long, module_id long, name string, purpose string, confidence double"),
        "component_files": t([(1, "src/auth/login.py", False), (1, "src/auth/tests/test_login.py", True), (2, "src/auth/token.py", False), (3, "src/utils/strings.py", False)], "component_id long, path string, is_test boolean"),
        "module_edges": t([(1, 2, "depends_on", 1.0, '{"label": "uses"}')], "source_id long, target_id long, edge_type string, weight double, metadata string"),
        "component_edges": t([(1, 2, "depends-on", 3.0, "oops")], "source_id long, target_id long, edge_type string, weight double, metadata string"),
        "decisions": t([(1, 1, None, "patterns", "Uses JWT for auth tokens", None, "pipeline_generated"), (2, None, 1, "libraries", "Python 3.12+", "a\nb", "human")], DECISIONS),
    }


def test_export_and_import(spark, tables):
    row = maptables.export_map(tables).first().asDict(recursive=True)
    assert [m["name"] for m in row["modules"]] == ["Auth Service", "Shared Utils"]
    assert row["modules"][0]["directories"] == ["src/auth", "src/auth/handlers"] and row["modules"][1]["decisions"] == []
    assert row["modules"][0]["components"][0]["files"][1] == {"path": "src/auth/tests/test_login.py", "is_test": True}
    assert row["component_edges"][0]["metadata"] == "{}" and json.loads(row["module_edges"][0]["metadata"]) == {"label": "uses"}
    empty = maptables.export_map({k: v.limit(0) for k, v in tables.items()}).first()
    assert (empty.modules, empty.module_edges, empty.component_edges) == ([], [], [])
    back = maptables.import_map(maptables.export_map(tables))
    assert {r.table_name: r.n for r in maptables.table_counts(back).collect()} == {k: v.count() for k, v in tables.items()}
    assert maptables.export_map(back).first().modules == maptables.export_map(tables).first().modules


PUBLISHED = {
    "modules": [
        {
            "id": 7, "name": "Shop", "classification": "module", "type": "service", "technology": "Go", "source_origin": "in-repo", "deployment_target": "k8s", "directories": ["cmd", "shop"],
            "decisions": [{"id": 70, "category": "patterns", "text": "one", "detail": None, "source": "human"}],
            "components": [
                {"id": 71, "name": "Cart", "purpose": "holds", "confidence": 0.9, "files": [{"path": "shop/cart.go", "is_test": False}, {"path": "shop/cart_test.go", "is_test": True}], "decisions": [{"id": 72, "category": "libraries", "text": "two", "detail": "d", "source": "chat"}]},
                {"id": 73, "name": "Pay", "purpose": None, "confidence": None, "files": [], "decisions": []},
            ],
        },
        {"id": 9, "name": "Log", "classification": "shared-library", "type": None, "technology": None, "source_origin": "external", "deployment_target": None, "directories": [], "decisions": [], "components": []},
    ],
    "module_edges": [{"source_id": 7, "target_id": 9, "edge_type": "depends_on", "weight": 1.0, "metadata": {"label": "uses Log", "n": {"deep": [1, 2]}}}],
    "component_edges": [{"source_id": 71, "target_id": 73, "edge_type": "call", "weight": 3.5, "metadata": {}}, {"source_id": 71, "target_id": 99, "edge_type": "call", "weight": 1.0, "metadata": {}}],
}


def renumbered(doc):
    """The document as an import numbers it; the edge to nowhere is gone."""
    new = json.loads(json.dumps(doc))
    modules, components, decisions = {7: 1, 9: 2}, {71: 1, 73: 2}, {70: 1, 72: 2}
    for m in new["modules"]:
        m["id"] = modules[m["id"]]
        for c in m["components"]:
            c["id"] = components[c["id"]]
        for d in m["decisions"] + [d for c in m["components"] for d in c["decisions"]]:
            d["id"] = decisions[d["id"]]
    for name, ids in (("module_edges", modules), ("component_edges", components)):
        new[name] = [e | {"source_id": ids[e["source_id"]], "target_id": ids[e["target_id"]]} for e in new[name] if e["target_id"] in ids]
    return new


def filled(x):
    """Without nulls, which JSON texts here leave out."""
    if isinstance(x, dict):
        return {k: filled(v) for k, v in x.items() if v is not None}
    return [filled(v) for v in x] if isinstance(x, list) else x


@pytest.mark.parametrize("wrapped", [True, False])
def test_published_map_round_trip(spark, tmp_path, wrapped):
    text = json.dumps({"version": 1, "map": PUBLISHED} if wrapped else PUBLISHED)
    lines = spark.createDataFrame([(text,), ("{}",), ("no json",)], "value string")
    good, bad = readers.read_map_json(lines)
    assert good.count() == 1 and bad.count() == 2 and checks.check_import(good).count() == 0
    tables = maptables.import_map(good)
    assert maptables.eligible_modules(tables["modules"]).select("name").collect() == [("Shop",)]
    readers.write_map_json(maptables.export_map(tables), str(tmp_path / "map"))
    back = json.loads(spark.read.text(str(tmp_path / "map")).first().value)
    assert back["version"] == 1 and filled(back["map"]) == filled(renumbered(PUBLISHED))
    again = maptables.import_map(readers.read_map_json(spark.read.text(str(tmp_path / "map")))[0])
    assert maptables.export_map(again).first() == maptables.export_map(tables).first()


def test_import_defaults_and_check(spark):
    doc = {"modules": [{"id": 1, "name": "A", "decisions": [{"category": "c", "text": "t"}], "components": [{"id": 5, "name": "C", "files": [{"path": "p"}]}]}, {"id": 2, "name": " "}], "module_edges": [{"source_id": 1, "target_id": 2, "edge_type": "x"}]}
    maps, _ = readers.read_map_json(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    t = maptables.import_map(maps)
    assert t["modules"].where("name = 'A'").first().classification == "module" and t["decisions"].first().source == "pipeline_generated"
    assert t["component_files"].first().is_test is False and t["module_edges"].first().weight == 1.0 and t["module_edges"].first().metadata == "{}"
    assert [(r.id, r.reason) for r in checks.check_import(maps).collect()] == [(2, "no name")]


def test_cascades(spark, tables):
    left = maptables.delete_modules(tables, tables["modules"].where("module_id = 1"))
    assert {k: v.count() for k, v in left.items()} == {"modules": 1, "module_directories": 1, "components": 1, "component_files": 1, "module_edges": 0, "component_edges": 0, "decisions": 0}
    less = maptables.delete_components(tables, tables["components"].where("component_id = 1"))
    assert [r.decision_id for r in less["decisions"].collect()] == [1] and less["component_edges"].count() == 0
    moved = maptables.move_files(tables["component_files"], spark.createDataFrame([(1, "src/auth/login.py", 2), (2, "src/utils/strings.py", 1)], "component_id long, path string, target_id long"))
    assert {r.path: r.component_id for r in moved.collect()}["src/auth/login.py"] == 2 and moved.where("component_id = 1").count() == 1


MODULE_DOC = {
    "modules": [
        {"id": "web", "name": "Web", "type": "app", "technology": "TS", "sourceOrigin": "in-repo", "deploymentTarget": "cdn", "directories": ["codebase/src/web", "codebase/src/web", "lib/"],
         "relationships": [
             {"targetModuleId": "api", "type": "communicates_via", "protocol": "REST", "description": "asks"}, {"targetModuleId": "api", "type": "communicates_via", "description": "again"},
             {"targetModuleId": "store", "type": "uses_data_store"}, {"targetModuleId": "kit"}, {"targetModuleId": "nowhere"}, {"type": "depends_on"}]},
        {"id": "api", "name": "API", "classification": "module", "relationships": {"dependsOnModules": ["store"], "usesDataStores": ["store"], "communicatesVia": [{"targetModuleId": "web", "protocol": "", "description": "calls back"}]}},
        {"id": "store", "name": "Store", "classification": "supporting-asset", "consumedBy": ["web"]},
        {"id": "kit", "name": "Kit", "classification": "shared-library", "consumedBy": ["web", "api", "nobody"]},
    ]
}


def test_ingestion_of_one_document(spark):
    out = maptables.ingest_modules_single(spark.createDataFrame([(json.dumps(MODULE_DOC),)], "value string"))
    mods = {r.key: r for r in out["modules"].collect()}
    assert {k: (r.module_id, r.name, r.classification) for k, r in mods.items()} == {"web": (1, "Web", "module"), "api": (2, "API", "module"), "store": (3, "Store", "supporting-asset"), "kit": (4, "Kit", "shared-library")}
    assert (mods["web"].type, mods["web"].technology, mods["web"].source_origin, mods["web"].deployment_target) == ("app", "TS", "in-repo", "cdn")
    assert sorted(r.directory for r in out["module_directories"].collect()) == ["lib/", "src/web"]
    edges = {(r.source_id, r.target_id, r.edge_type): (r.weight, json.loads(r.metadata)) for r in out["module_edges"].collect()}
    assert edges == {
        (1, 2, "communicates_via"): (1.0, {"label": "REST: API", "protocol": "REST", "description": "asks"}),
        (1, 3, "uses_data_store"): (1.0, {"label": "stores data in Store", "description": "Connects to Store"}),
        (1, 4, "depends_on"): (1.0, {"label": "uses Kit", "description": "Web depends on Kit"}),
        (2, 3, "depends_on"): (1.0, {"label": "uses Store", "description": "Depends on store"}),
        (2, 3, "uses_data_store"): (1.0, {"label": "stores data in Store", "description": "Stores data in store"}),
        (2, 1, "communicates_via"): (1.0, {"label": "calls Web", "protocol": "", "description": "calls back"}),
        (2, 4, "depends_on"): (1.0, {"label": "uses Kit", "description": "API imports Kit"}),
    }


def test_ingestion_of_two_documents(spark):
    mods = maptables.ingest_modules(spark.createDataFrame([(json.dumps(MODULE_DOC),)], "value string"))["modules"]
    doc = {
        "edges": [
            {"sourceId": "web", "targetId": "api", "type": "communicates_via", "description": "x"}, {"sourceId": "web", "targetId": "web"}, {"sourceId": "web", "targetId": "zzz"}, {"sourceId": "api"},
            {"sourceId": "web", "targetId": "store", "type": "uses_data_store"}, {"sourceId": "web", "targetId": "store", "type": "uses_data_store", "description": "later"}, {"sourceId": "api", "targetId": "kit", "type": "uses_data_store"}],
        "consumedBy": [{"libraryId": "kit", "consumerIds": ["api", "kit", "none"]}, {"libraryId": "none", "consumerIds": ["web"]}],
    }
    edges, skipped = maptables.ingest_edges(spark.createDataFrame([(json.dumps(doc),)], "value string"), mods)
    got = {(r.source_id, r.target_id, r.edge_type): json.loads(r.metadata) for r in edges.collect()}
    assert got == {
        (1, 2, "communicates_via"): {"label": "calls API", "protocol": "", "description": "x"},
        (1, 3, "uses_data_store"): {"label": "stores data in Store", "description": ""},
        (2, 4, "uses_data_store"): {"label": "stores data in Kit", "description": ""},
        (2, 4, "depends_on"): {"label": "uses Kit"},  # another type doesn't fill it
        (4, 4, "depends_on"): {"label": "uses Kit"},
    }
    assert sorted(map(tuple, skipped.collect())) == [("web", "web"), ("web", "zzz")]
    # A null key and an edge without any.
    none, skipped = maptables.ingest_edges(spark.createDataFrame([('{"edges": []}',)], "value string"), mods)
    assert none.collect() == [] and skipped.collect() == []


def test_new_files_are_classified(spark):
    new = spark.createDataFrame([(1, f"src/a/{n}.py") for n in ("x", "y", "z", "q")] + [(1, "src/a/tests/test_x.py"), (2, "lib/w.py"), (2, "lib/tests/test_w.py"), (2, "util_kit/test_v.py")], "module_id long, path string")
    comps = spark.createDataFrame([(1, 10, "Core"), (2, 11, "Core"), (2, 12, "UtilKit")], "module_id long, component_id long, name string")
    answers = [(1, "src/a/x.py", "Core", None, None), (1, "src/a/y.py", None, "Fresh", "does y"), (1, "src/a/z.py", "Fresh?", "Fresh", "does z"), (1, "src/a/q.py", "Unknown", None, None), (2, "lib/w.py", "Unknown", "Core", "no"), (2, "gone.py", "Core", None, None)]
    files, fresh, stats = maptables.apply_classification(new, comps, spark.createDataFrame(answers, "module_id long, path string, existing_component string, new_component string, purpose string"))
    assert sorted(map(tuple, fresh.collect())) == [(13, 1, "Fresh", "does y", 0.5)]
    assert {r.path: (r.component_id, r.is_test) for r in files.collect()} == {"src/a/x.py": (10, False), "src/a/y.py": (13, False), "src/a/z.py": (13, False), "lib/w.py": (11, False), "src/a/tests/test_x.py": (10, True), "lib/tests/test_w.py": (11, True), "util_kit/test_v.py": (12, True)}
    assert tuple(stats.first()) == (8, 7, 1, 1)


def test_tickets(spark):
    answer = [
        {"title": "T1", "description": ["a", "b"], "acceptance_criteria": ["c"], "affected_files": "one.py", "change_record_ids": [1, 5, 99]},
        {"is_map_correction": True, "title": "no"},
        {"title": ["T", 2], "description": None, "affected_files": ["x", "y", "x"], "is_map_correction": False},
    ]
    rows = spark.createDataFrame([(1, json.dumps(answer)), (2, "[]"), (3, None)], "request_id long, json string")
    changed = spark.createDataFrame([(1,), (5,), (6,)], "change_id long")
    tickets, files, links, stats = maptables.build_tickets(rows, changed)
    assert sorted(map(tuple, tickets.collect())) == [(1, "T1", "a\nb", "c"), (2, "T\n2", "", "")]
    assert sorted(map(tuple, files.collect())) == [(1, "one.py"), (2, "x"), (2, "y")]
    assert sorted(map(tuple, links.collect())) == [(1, 1), (1, 5)] and tuple(stats.first()) == (2, 1)
    more = spark.createDataFrame([(3, "T3", "d", "")], tickets.schema)
    assert {r.ticket_id: r.files for r in maptables.tickets_with_files(tickets.unionByName(more), files).collect()} == {1: ["one.py"], 2: ["x", "y"], 3: []}
    text = {r.ticket_id: r.text for r in textbatch.render_tickets(tickets, files).collect()}
    assert text[1] == "## T1\n\na\nb\n\n**Acceptance criteria:**\nc\n\n**Files:**\n- `one.py`"
    of = spark.createDataFrame([(1, 4)], "ticket_id long, decision_id long")
    assert sorted(map(tuple, maptables.link_ticket_decisions(of, of.unionByName(spark.createDataFrame([(1, 6)], of.schema))).collect())) == [(1, 4), (1, 6)]


def test_search_overview_flags(spark, tables):
    hits = maptables.search_entities(tables["modules"], tables["components"], tables["decisions"], "jwt").collect()
    assert [(r.entity_type, r.owner) for r in hits] == [("decision", "Auth Service")]
    assert {r.module_id: (r.components, r.decisions) for r in maptables.map_overview(tables["modules"], tables["components"], tables["decisions"]).collect()} == {1: (2, 2), 2: (1, 0)}
    odd = spark.createDataFrame([(5, r"a\b 100% SÜD", "module")], "module_id long, name string, classification string")
    for text, n in ((r"A\B", 1), ("100%", 1), ("1_0", 1), ("süd", 0), ("sÜd", 1), ("\\", 1), ("zz", 0)):
        assert maptables.search_entities(odd, tables["components"].limit(0), tables["decisions"].limit(0), text).count() == n, text
    assert {r.classification: r.modules for r in maptables.overview_totals(tables["modules"]).collect()} == {"module": 1, "shared-library": 1}
    rows = maptables.select_rows(tables["decisions"], module_id=None, source="human")
    assert [r.decision_id for r in rows.collect()] == [2]
    nodes = spark.createDataFrame([("module", 1), ("component", 1), ("component", 2)], "kind string, id long")
    ch = spark.createDataFrame([(1, None)], "module_id long, component_id long")
    oc = spark.createDataFrame([(None, 1, "updated"), (None, 2, "confirmed")], "module_id long, component_id long, status string")
    assert {(r.kind, r.id): (r.changed, r.revalidated) for r in maptables.flag_nodes(nodes, ch, oc).collect()} == {("module", 1): (True, False), ("component", 1): (False, True), ("component", 2): (False, False)}


def test_versions(spark, tables):
    d = tables["decisions"]
    none = spark.createDataFrame([], "version long")
    row, frozen = versions.create_snapshot(d, tables["components"], tables["modules"], none, "manual", "now")
    assert row.first().version == 1 and json.loads(row.first().summary) == {"total": 2, "module_level": 1, "component_level": 1, "modules": 2, "components": 3}
    new = d.where("decision_id = 2").withColumn("text", F.lit("Python 3.13")).unionByName(d.limit(1).withColumn("decision_id", F.lit(9).cast("long")))
    diff = versions.compare_versions(frozen, new.withColumns({"module_name": F.lit("M"), "component_name": F.lit(None).cast("string")}))
    got = {r.decision_id: (r.change, r.module_name, r.component_name, r.old_source, r.new_source) for r in diff.collect()}
    assert got == {1: ("removed", "Auth Service", "", "pipeline_generated", None), 2: ("changed", "M", None, "human", "human"), 9: ("added", "M", None, None, "pipeline_generated")}
    assert tuple(versions.change_counts(diff).first()) == (1, 1, 1, 0)
    assert versions.compare_versions(frozen, d.withColumn("source", F.lit("x"))).where("change <> 'unchanged'").count() == 0
    listed = versions.list_versions(row.unionByName(row.withColumn("summary", F.lit("bad")).withColumn("version", F.lit(2).cast("long")))).collect()
    assert [r.version for r in listed] == [2, 1] and listed[0].summary is None and listed[1].summary.total == 2


def test_validation_outcomes(spark, tables):
    o = spark.createDataFrame([(0, 1, "updated", "better", None, None, None), (1, 2, "updated", "never", None, None, None), (2, None, "new", "fresh", "patterns", 1, None)], "ord long, decision_id long, status string, new_text string, category string, module_id long, component_id long")
    got = {r.decision_id: r.text for r in versions.apply_validations(tables["decisions"], o).collect()}
    assert got == {1: "better", 2: "Python 3.12+", 3: "fresh"}
    runs = spark.createDataFrame([(1, "completed", "a", None), (2, "completed", "b", '{"new_file_paths": ["p", "q"]}'), (3, "running", "c", None)], "run_id long, status string, created_at string, summary string")
    seen = spark.createDataFrame([(0, 2, "updated", 1), (1, 2, "outdated", 2), (2, 2, "confirmed", 2), (3, 1, "updated", 2), (4, 2, "new", None)], "ord long, run_id long, status string, decision_id long")
    counts, rows = versions.validation_summary(runs, seen, tables["decisions"])
    assert {r.status: r.n for r in counts.collect()} == {"updated": 1, "outdated": 1, "confirmed": 1, "new": 1} and rows.count() == 3
    assert tuple(versions.validation_overview(runs, seen, tables["decisions"]).first()) == (2, [1], [1], ["p", "q"])
    assert tuple(versions.validation_overview(runs.where("run_id = 3"), seen, tables["decisions"]).first()) == (None, [], [], [])
    begun = runs.drop("created_at").unionByName(versions.start_run(runs, 4, "d").select("run_id", "status", "summary"))
    assert begun.where("status = 'running'").orderBy("run_id").collect()[-1].run_id == 4
    every = runs.withColumns({"before_version": F.lit(1).cast("long"), "after_version": F.lit(None).cast("long")})
    done = versions.complete_run(every, 3, 9, "{}").where("run_id = 3").first()
    assert (done.status, done.after_version, done.summary) == ("completed", 9, "{}") and [r.run_id for r in versions.list_runs(runs).collect()] == [3, 2, 1]
    joined = versions.join_validations(seen.drop("ord"), tables["decisions"]).collect()
    assert {(r.status, r.decision_id): r.old_text for r in joined if r.run_id == 2} == {("updated", 1): "Uses JWT for auth tokens", ("outdated", 2): None, ("confirmed", 2): None, ("new", None): None}
    stats = versions.validation_stats(o.withColumn("run_id", F.lit(1))).first()
    assert (stats.updated, stats.new, stats.confirmed) == (2, 1, 0)
    e = spark.createDataFrame([(0, 2, "patterns", "all use it", None, [2])], "ord long, module_id long, category string, text string, detail string, source_ids array<long>")
    assert {r.decision_id: r.text for r in versions.apply_elevation(tables["decisions"], e).collect()} == {1: "Uses JWT for auth tokens", 3: "all use it"}
    assert [r.decision_id for r in versions.clear_generated(tables["decisions"]).collect()] == [2]


def test_badges_and_new_files(spark, tables):
    ch = log(spark, [("decision", 1, "add", None, V[1]), ("decision", 1, "edit", V[1], V[2]), ("module", 2, "remove", V[1], None)])
    oc = spark.createDataFrame([(0, 2, "outdated", None, "old"), (1, 2, "updated", "was", "new")], "ord long, decision_id long, status string, old_text string, reason string")
    assert {r.decision_id: tuple(r)[1:] for r in versions.decision_badges(tables["decisions"], ch, oc).collect()} == {1: ("edit", None, None, None), 2: (None, "updated", "was", "new")}
    flagged = versions.flag_new_files(tables["component_files"], spark.createDataFrame([(["src/auth/token.py"],)], "paths array<string>"))
    assert {r.path for r in flagged.where("is_new").collect()} == {"src/auth/token.py"} and flagged.count() == 4


def test_requests(spark, tables):
    batches = spark.createDataFrame([(1, 0, "b.py", "B"), (1, 0, "a.py", "A"), (1, 1, "c.py", "C")], "component_id long, batch_no int, path string, content string")
    assert {(r.component_id, r.batch_no): r.body for r in textbatch.render_batches(batches, "component_id").collect()} == {(1, 0): "--- file: a.py ---\nA\n\n--- file: b.py ---\nB", (1, 1): "--- file: c.py ---\nC"}
    assert {r.batch_no: r.request for r in textbatch.decision_requests(batches, "component_id", "Read <{files}> now").collect()}[1] == "Read <--- file: c.py ---\nC> now"
    more = tables["decisions"].unionByName(spark.createDataFrame([(3, None, 2, "patterns", "keeps tokens", None, "human")], DECISIONS))
    assert [(r.module_id, r.request) for r in textbatch.elevation_requests(more, tables["components"]).collect()] == [(1, "## Login Handler\n[2] (libraries) Python 3.12+\n\n## Token Manager\n[3] (patterns) keeps tokens")]
    assert textbatch.elevation_requests(tables["decisions"], tables["components"]).collect() == []
    asked = textbatch.validation_requests(tables["components"], tables["component_files"], more.withColumn("source", F.when(F.col("decision_id") == 3, "chat").otherwise(F.col("source")))).collect()
    assert {r.component_id: (r.pipeline_decisions, r.human_decisions, r.files) for r in asked} == {1: ("", "[2] (libraries) Python 3.12+", ["src/auth/login.py"]), 2: ("[3] (patterns) keeps tokens", "", ["src/auth/token.py"])}
    new = spark.createDataFrame([(1, "n.py", "x\ny\nz"), (2, "p.png", "x"), (9, "q.py", "q")], "module_id long, path string, content string")
    got = {r.path: r.request for r in textbatch.classification_requests(new, tables["components"], 2).collect()}
    assert got == {"n.py": "- Login Handler: logs in\n- Token Manager: \n\n--- file: n.py ---\nx\ny\n... (truncated at 2 lines)", "q.py": "(none)\n\n--- file: q.py ---\nq"}
    assert tuple(textbatch.usage_stats(spark.createDataFrame([(1, 2), (3, None)], "input_tokens long, output_tokens long")).first()) == (4, 2, 6)


def test_cluster_requests(spark):
    assign = spark.createDataFrame([("a/x.py", 0), ("a/y.py", 0), *((f"b/{i:02d}.py", 1) for i in range(40))], "node string, cluster int")
    meta = spark.createDataFrame([("a/x.py", [f"e{i}" for i in range(7)], "Says\nthis" + "." * 200), ("a/y.py", [], "")], "path string, exports array<string>, docstring string")
    dirs = spark.createDataFrame([(0, "a", 2, 1), (1, "b", 40, 1)], "cluster int, dir string, n long, rank int")
    edges = spark.createDataFrame([(0, "a/x.py", "a/y.py", 3, 1)], "cluster int, src string, dst string, cnt long, rank int")
    got = {r.cluster: r.request for r in textbatch.cluster_requests(assign, meta, dirs, edges, most_tokens=100).collect()}
    assert got[0] == "- a/x.py [e0, e1, e2, e3, e4]: Says this" + "." * 141 + "\n- a/y.py\nDirectories: a (2)\nCalls:\na/x.py -> a/y.py (3)"
    assert got[1].count("\n- ") == 29 and "... and 10 more files" in got[1]
    assert "more files" not in {r.cluster: r.request for r in textbatch.cluster_requests(assign, meta, dirs, edges).collect()}[1]


def test_edge_tables(spark):
    e = spark.createDataFrame([("A", "B", "call", 2.5), ("B", "A", "call", 1.0), ("B", "C", "import", 4.0)], "source string, target string, edge_type string, weight double")
    labels = spark.createDataFrame([("A", "B", "call", 0, "first"), ("A", "B", "call", 1, "last"), ("A", "B", "call", 2, " "), ("X", "B", "call", 0, "no")], "source string, target string, edge_type string, ord int, label string")
    assert {(r.source, r.target): r.label for r in rollup.apply_edge_labels(e, labels).collect()} == {("A", "B"): "last", ("B", "A"): "", ("B", "C"): ""}
    nodes = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("C", "Gamma")], "node string, label string")
    hits, touched = rollup.search_graph(nodes, e, " alp ")
    assert [r.node for r in hits.collect()] == ["A"] and touched.count() == 2
    assert rollup.search_graph(nodes, e, " ")[0].count() == 3 and rollup.search_graph(nodes, e, "")[1].count() == 3
    assert rollup.incident_edges(e, "A").count() == 2 and rollup.incident_edges(e, "Z").count() == 0
    assert {r.node: r.degree for r in rollup.node_degrees(e).collect()} == {"A": 2, "B": 3, "C": 1}
    assert {r.node: r.degree for r in rollup.node_degrees(e, distinct_pairs=True).collect()} == {"A": 1, "B": 2, "C": 1}
    assert tuple(rollup.edge_facets(e).first()) == (["call", "import"], 0.0, 4.0) and tuple(rollup.edge_facets(e.limit(0)).first()) == ([], 0.0, 1.0)
    comps = spark.createDataFrame([(1, "A", "does a"), (1, "B", None), (1, "C", "unused")], "module_id long, name string, purpose string")
    asked = rollup.edge_label_requests(e.withColumn("module_id", F.lit(1).cast("long")), comps, top=2).collect()
    assert [r.request for r in asked] == ["- A: does a\n- B: \n- C: unused\n\n1. B -> C (import, 4.0)\n2. A -> B (call, 2.5)"]


def test_edges_are_refreshed(spark):
    files = spark.createDataFrame([(1, "A", "a1"), (1, "B", "b1"), (2, "C", "c1"), (3, "D", "d1"), (3, "E", "e1")], "module_id long, component string, path string")
    fedges = spark.createDataFrame([("a1", "b1", "call", 3), ("a1", "c1", "call", 9), ("d1", "e1", "import", 2)], "src string, dst string, edge_type string, cnt long")
    old = spark.createDataFrame([("A", "B", "import", 1.0), ("C", "Q", "call", 2.0), ("D", "C", "call", 1.0)], "source string, target string, edge_type string, weight double")
    assert sorted(map(tuple, rollup.refresh_edges(fedges, files, old).collect())) == [("A", "B", "call", 10.0), ("C", "Q", "call", 2.0), ("D", "E", "import", 10.0)]


def test_edits(spark, tables):
    p = spark.createDataFrame([(1, "New text", None)], "decision_id long, text string, category string")
    row = changes.update_decisions(tables["decisions"], p).where("decision_id = 1").first()
    assert (row.text, row.category, row.source) == ("New text", "patterns", "human")
    known = spark.createDataFrame([(1, "a"), (None, "a")], "x long, y string")
    ok, bad = changes.insert_unique(known, spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "a")], "x long, y string"), ["x", "y"], ["y"])
    assert sorted(map(str, ok.collect())) == ["Row(x=2, y='b')", "Row(x=None, y='a')"] and bad.count() == 2
    props = spark.createDataFrame([(1, "pending", "edit", 1, None, "t", None), (2, "pending", "remove", 2, None, None, None), (3, "applied", "add", None, "c", "z", None), (4, "pending", "add", None, "c", "n", None), (5, "pending", "add", None, "c", "no", None)], "proposal_id long, status string, action string, decision_id long, category string, text string, detail string")
    after, live, skipped = changes.apply_proposals(props, spark.createDataFrame([(1,), (2,), (3,), (4,)], "proposal_id long"), tables["decisions"])
    assert [r.status for r in after.orderBy("proposal_id").collect()] == ["applied", "applied", "applied", "applied", "rejected"]
    assert {r.decision_id: r.text for r in live.collect()} == {1: "t", 3: "n"} and [r.proposal_id for r in skipped.collect()] == [3]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}), ('  {"a": 1}\n', {"a": 1}), ('x\n```json\n{"a": 2}\n```\ny', {"a": 2}), ('```\n{"a": 3}\n```', {"a": 3}), ('```python\n{"a": 4}\n```', {"a": 4}),
        ('I say {"a": {"b": 5}} so', {"a": {"b": 5}}), ("[1, 2]", [1, 2]), ('```json\n{"a": 6}\n```\n```json\n{"a": 7}\n```', {"a": 6}), ("nothing", None), (None, None), ("", None),
    ],
)
def test_response_json(spark, text, want):
    row = spark.createDataFrame([(text,)], "text string").select(textbatch.extracted_json("text").alias("j")).first()
    assert (row.j and json.loads(row.j)) == want


def test_text_helpers(spark):
    rows = spark.createDataFrame([(1, "A & B!"), (2, "A  B"), (3, "!!"), (4, "x-y_z")], "module_id long, name string")
    assert {r.module_id: r.file_name for r in textbatch.with_doc_filename(rows).collect()} == {1: "A_B", 2: "A_B_2", 3: "Module_3", 4: "x-y_z"}
    odd = ["1\r\n2\n3", "1\n2", "1\n2\n", "1\r2", "", "\n", "\n\n\n", "a\x0bb\u2028c", "x\x85", "1\n2\n3\n", "no end"]
    files = spark.createDataFrame([(f"{i}.py", t) for i, t in enumerate(odd)] + [("b.PNG", "x")], "path string, content string")
    lines = [t.splitlines() for t in odd]
    want = {f"{i}.py": "\n".join(x if len(x) <= 2 else [*x[:2], "... (truncated at 2 lines)"]) for i, x in enumerate(lines)}
    assert {r.path: r.content for r in textbatch.cap_lines(files, 2).collect()} == want
    sizes = spark.createDataFrame([("g", "a", 60), ("g", "b", 50), ("g", "c", 50), ("g", "d", 200), ("h", "a", 500), ("i", "a", 0), ("i", "b", 101), (None, "a", 60), (None, "b", 60)], "g string, path string, size long")
    got = {(r.g, r.path): r.batch_no for r in textbatch.batch_by_budget(sizes, "g", "path", "size", 100).collect()}
    assert got == {("g", "a"): 0, ("g", "b"): 1, ("g", "c"): 1, ("g", "d"): 2, ("h", "a"): 0, ("i", "a"): 0, ("i", "b"): 1, (None, "a"): 0, (None, "b"): 1}
    twice = textbatch.batch_by_budget(sizes.unionByName(sizes), "g", "path", "size", 10**6)
    assert twice.count() == 2 * len(got) and {r.batch_no for r in twice.collect()} == {0}
    d = spark.createDataFrame([(1, 'a.py', '"""Doc\nstring."""\nx = 1\n'), (2, "b.py", "x = 1\n'''no'''"), (3, "c.js", '"""x"""'), (4, "d.py", ""), (5, "e.py", "'''" + "y" * 600 + "'''")], "i int, path string, content string")
    found = {r.path: (r.d, r.n) for r in d.select("path", textbatch.docstring().alias("d"), textbatch.line_count().alias("n")).collect()}
    assert found["a.py"] == ("Doc\nstring.", 3) and found["b.py"] == ("", 2) and found["c.js"][0] == "" and found["d.py"] == ("", 0) and len(found["e.py"][0]) == 503
    v = spark.createDataFrame([("patterns", " t ", " "), ("nope", "t", None), ("patterns", "  ", None)], "category string, text string, detail string")
    assert list(map(tuple, textbatch.validate_decisions(v).collect())) == [("patterns", "t", None)]


def test_rendering(spark, tables):
    text = textbatch.render_components(tables["components"], tables["component_files"], tables["decisions"]).where("component_id = 1").first().body
    assert text.startswith("### Login Handler\n\n**Purpose:** logs in") and "`src/auth/tests/test_login.py` *(test)*" in text and "  > a\n  > b" in text
    docs = {r.file_name: r.text for r in textbatch.render_modules(tables["modules"], tables["components"], tables["component_files"], tables["decisions"], tables["module_edges"]).collect()}
    assert set(docs) == {"Auth_Service", "Shared_Utils"} and "Shared Utils (depends_on)" in docs["Auth_Service"]
    toc = textbatch.render_toc(tables["modules"], tables["module_edges"], "Map", "now").first().text
    assert "[Auth Service](Auth_Service.md)" in toc and "Auth Service -> Shared Utils" in toc
    net = spark.createDataFrame([("decision", 1, "edit", "x", "y")], "entity_type string, entity_id long, action string, old_value string, new_value string")
    assert textbatch.ticket_request(net).first().request == '1. EDIT decision on component "unknown component" (module: unknown module)\n'


def test_indexes_merge(spark):
    e = lambda rows: spark.createDataFrame(rows, "src string, dst string, edge_type string, cnt long")
    f = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    st = lambda rows: spark.createDataFrame(rows, "index_id string, n_definitions long, n_files long")
    parts = [(e([("a", "b", "call", 2)]), f("ab"), st([("py", 5, 2)])), (e([("a", "b", "call", 3), ("a", "c", "import", 1)]), f("abc"), st([("ts", 4, 3)])), (e([]), f(""), st([("go", 9, 0)]))]
    edges, files, stats = resolution.merge_index_results(parts)
    assert sorted(map(tuple, edges.collect())) == [("a", "b", "call", 5), ("a", "c", "import", 1)] and files.count() == 3
    assert stats.first().asDict() == {"n_definitions": 9, "n_indexes": 2, "n_files": 3}


def test_near_statements(spark):
    base = "every service keeps its own tables and never reads the tables of another one"
    rows = [(1, c, "patterns", base + x) for c, x in ((1, ""), (2, " at all"), (3, " today"))] + [(1, 4, "patterns", "logs are json"), (1, 3, "libraries", base), (2, 5, "patterns", base), (2, 6, "patterns", "other words")]
    d = spark.createDataFrame(rows, "module_id long, component_id long, category string, text string")
    assert textbatch.cross_cutting(d).collect() == []
    assert [tuple(r) for r in textbatch.cross_cutting(d, similar=0.75).collect()] == [(1, "patterns", base, 3, 4)]
    assert textbatch.cross_cutting(d.limit(0), similar=0.75).collect() == []


def test_tables_are_replaced_and_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "parts")
    readers.overwrite_partitions(df, path, ["k"])
    for _ in range(2):
        readers.overwrite_partitions(spark.createDataFrame([(2, "c"), (3, "d")], df.schema), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    readers.write_docs(spark.createDataFrame([("one", "# One\ntext"), ("two", "# Two")], "file_name string, text string"), str(tmp_path / "docs"))
    assert sorted(p.name for p in (tmp_path / "docs").iterdir() if p.is_dir()) == ["file_name=one", "file_name=two"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "docs")).collect()) == ["# One", "# Two", "text"]
    nested = spark.createDataFrame([("i", "file:///r", "t", "1", [("a.py", "py", "", [("S", 1, [0])], [])])], readers.INDEX)
    for kind in ("json", "parquet"):
        nested.write.format(kind).save(str(tmp_path / kind))
        assert readers.read_index(spark, str(tmp_path / kind), kind).occurrences.first().symbol == "S"


def test_file_drilldown(spark):
    occ = spark.createDataFrame([("i", 0, 0, "a.py", "S", 1, [1]), ("i", 1, 0, "b.py", "S", 0, [2]), ("i", 1, 1, "b.py", "S", 0, [90]), ("i", 1, 2, "b.py", "local 1", 0, [3])], "index_id string, doc_ord long, occ_ord long, relative_path string, symbol string, symbol_roles int, range array<int>")
    sym = spark.createDataFrame([("i", 1, 0, "b.py", "B", 7)], "index_id string, doc_ord long, sym_ord long, relative_path string, symbol string, kind int")
    rel = spark.createDataFrame([("i", "b.py", "B", "S", True)], "index_id string, relative_path string, symbol string, target_symbol string, is_implementation boolean")
    out = diagnostics.file_drilldown(occ, sym, rel, "b.py")
    assert tuple(out["profile"].first()) == ("b.py", 2, 0, 1, 3, 1) and [tuple(r) for r in out["targets"].collect()] == [("a.py", 2)]
    assert sorted(r.range[0] for r in out["early"].collect()) == [2, 3] and [r.symbol for r in out["related"].collect()] == ["B"]
    assert tuple(diagnostics.occurrence_totals(occ).first()) == ("i", 4, 0, 1, 3)


def test_sources(spark, tmp_path):
    ok, bad = readers.admit_files(spark.createDataFrame([("a", 5), ("b", 0), ("c", None), ("d", 10**10)], "path string, length long"))
    assert [r.path for r in ok.collect()] == ["a"] and {r.path: r.reason for r in bad.collect()} == {"b": "empty", "c": "missing", "d": "too large"}
    (tmp_path / "r.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    good, quarantine, stats = readers.scan_permissive(spark, str(tmp_path / "r.json"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and quarantine.first().value == "broken" and tuple(stats.first()) == (3, 2, 1)
    raw = spark.createDataFrame([(bytearray(b"ok\xff"),)], "b binary").select(F.col("b").cast("string").alias("s"))
    assert readers.sanitize_utf8(raw).first().s == "ok�"
    (tmp_path / "t" / "node_modules").mkdir(parents=True)
    for name in ("a.py", ".h.py", "node_modules/x.js"):
        (tmp_path / "t" / name).write_text("x")
    got = {r.path: (r.ext, r.hidden) for r in readers.scan_files(spark, str(tmp_path / "t"), excludes=["node_modules/**"]).collect()}
    assert got["a.py"] == (".py", False) and "node_modules/x.js" not in got
    nested = [("i", "file:///r", "t", "1", [("a.py", "py", "", [("S", 1, [0])], [("S", 7, "S", [("B", True, False, False, False)])])])]
    flat = readers.flatten_index(spark.createDataFrame(nested, readers.INDEX))
    assert flat.occurrences.first().symbol == "S" and flat.relationships.first().target_symbol == "B" and flat.documents.count() == 1
    files = spark.createDataFrame([("Dockerfile", "FROM x"), ("m/package.json", '{"name": "n", "main": "i.js", "scripts": {"a": "b"}}'), ("m/k8s/d.yaml", "y"), ("other/Dockerfile", "no"), ("m/package.jsonx", "no")], "path string, content string")
    picked = {r.path: r.content for r in readers.select_deployment_files(files, spark.createDataFrame([(1, "m/")], "module_id long, directory string")).collect()}
    assert set(picked) == {"Dockerfile", "m/package.json", "m/k8s/d.yaml"} and json.loads(picked["m/package.json"]) == {"scripts": {"a": "b"}, "main": "i.js"}


def test_languages(spark):
    files = spark.createDataFrame([(p,) for p in ("a.py", "b.h", "x.js", "package.json", "node_modules/q/r.js", "s/node_modules/t.ts", "z.XYZ", "y.xyz", "README", "p.csproj")], "path string")
    assert {r.language: (r.source_files, r.config_files) for r in languages.language_report(files).collect()} == {"Python": (1, 0), "C": (1, 0), "JavaScript": (1, 1)}
    assert {r.ext: r.n for r in languages.unrecognised(files).collect()}["xyz"] == 2
    row = languages.coverage(files).first()
    assert (row.total, row.supported, row.excluded) == (8, 3, 2) and row.coverage == pytest.approx(37.5)
    counts = spark.createDataFrame([(f"e{i}", 10 - i) for i in range(8)], "ext string, n long")
    assert [(r.label, r.n) for r in languages.coverage_summary(counts).orderBy("rank").collect()][-1] == ("... and 3 more extensions (12 files)", 12)
    df = spark.createDataFrame([("Python",), ("C",)], "language string")
    assert languages.filter_languages(df, ["PY"]).count() == 1 and languages.filter_languages(df, []).count() == 2 and languages.filter_languages(df, ["zz"]).count() == 0


def test_checks(spark, tables):
    assert checks.check_owner(tables["decisions"]).count() == 0
    both = spark.createDataFrame([(1, 1), (None, None), (1, None)], "module_id long, component_id long")
    assert checks.check_owner(both).count() == 2
    assert checks.check_unique(spark.createDataFrame([(1,), (1,), (None,), (None,)], "x long"), ["x"]).count() == 1
    assert checks.check_fk(both, tables["modules"], "module_id", "module_id").count() == 0
    up = checks.upgrade_table(spark.createDataFrame([(1, "a"), (1, "b")], "x int, y string"), tables["module_edges"].select(F.lit(1).cast("long").alias("x"), F.lit("").alias("y"), F.lit(0.5).alias("z")).schema, ["x"])
    assert up.first() == (1, "a", None) and up.count() == 1
    assert checks.check_unique(spark.createDataFrame([(1, None), (1, None)], "x long, y long"), ["x", "y"]).count() == 0
    bad = checks.check_clustering(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("C", "a"), ("C", "z")], "component string, path string"))
    assert {r.kind for r in bad.collect()} == {"not clustered", "not a source file", "component count"}


def test_diagnostics(spark):
    occ = spark.createDataFrame([("i", 0, 0, "a.py", "S", 1), ("i", 1, 0, "b.py", "S", 0), ("i", 1, 1, "b.py", "T", 0), ("i", 1, 2, "b.py", "local x", 0), ("i", 1, 3, "b.py", "p q r s t", 0)], "index_id string, doc_ord long, occ_ord long, relative_path string, symbol string, symbol_roles int")
    sym = spark.createDataFrame([("i", 2, 0, "c.py", "T", 7)], "index_id string, doc_ord long, sym_ord long, relative_path string, symbol string, kind int")
    row = diagnostics.definition_sources(occ, sym).first()
    assert (row.both, row.only_occurrences, row.only_symbols) == (0, 1, 1)
    report = {r.definitions: (r.resolved, r.unresolved, r.file_pairs) for r in diagnostics.resolution_report(occ, sym).collect()}
    assert report == {"occurrences": (1, 2, 1), "combined": (2, 1, 2)}
    assert list(map(tuple, diagnostics.gained_edges(occ, sym).collect())) == [("b.py", "c.py")]
    assert {r.package for r in diagnostics.unresolved_packages(occ).collect()} == {"T", "p q r s"}
    assert tuple(diagnostics.missed_symbols(occ, sym).first()) == (1, 1, 1)
