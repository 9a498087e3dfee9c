"""Maps that come by sections: each line is parsed once, whatever it holds."""

import json
import random
import re

from depweave.operators import maptables
from depweave.plans import views
from depweave.sources.scratch import cut


def test_sections_are_parsed_once(spark):
    row = lambda section, **of: json.dumps({"section": section, "row": of})
    edge = lambda s, t, **of: row("component_edges", source_id=s, target_id=t, edge_type="call", **of)
    good = [
        row("modules", module_id=9, name="b"), row("modules", module_id=7, name="a", classification="x", weight="no"), row("module_directories", module_id=7, directory="d"),
        row("components", component_id=5, module_id=9, name="c", confidence=0.5), row("components", component_id=4, module_id=8, name="of nobody"),
        row("component_files", component_id=5, path="p"), row("decisions", decision_id=3, module_id=7, component_id=5, text="both"),
        row("decisions", decision_id=2, component_id=5, text="deep", source="human"), row("decisions", decision_id=1, module_id=8, text="of nobody"), row("decisions", decision_id=4, text="free"),
        row("decisions", decision_id="x", module_id=9, text="odd"), json.dumps({"section": "decisions"}), '{"section": "decisions"} x', edge(5, 5), edge(5, 4, weight=3.0),
    ]
    bad = [None, "", "x", "[]", '[{"section": "modules"}]', "{}", '{"section": 1}', '{"section": "other"}', '{"section": ["modules"]}', '{"section": {"a": 1}}', '{"section": "modules", ', '{"section": "modules", "section": "modules"}', '{"row": {"section": "modules"}}']
    lines = cut(spark.createDataFrame([(x,) for x in good + bad], "value string").repartition(3), "lines")
    tables, errors = maptables.read_sections(lines)
    read = lambda df: set(df.inputFiles())
    assert not any(read(t) & read(lines) for t in [*tables.values(), errors])
    key = lambda r: repr(r)
    assert sorted((r.value for r in errors.collect()), key=key) == sorted(bad, key=key)
    assert {r.reason for r in errors.collect()} == {"no section"}
    got = {name: sorted((tuple(r) for r in t.collect()), key=key) for name, t in maptables.import_tables(tables).items()}
    assert got == {
        "modules": [(1, "a", "x", None, None, None, None), (2, "b", "module", None, None, None, None)],
        "module_directories": [(1, "d")],
        "components": [(1, 2, "c", None, 0.5)],
        "component_files": [(1, "p", False)],
        "decisions": [(1, 1, None, None, "both", None, "pipeline_generated"), (2, 2, None, None, "odd", None, "pipeline_generated"), (3, None, 1, None, "deep", None, "human"), (4, None, 1, None, "both", None, "pipeline_generated")],
        "module_edges": [],
        "component_edges": [(1, 1, "call", 1.0, "{}")],
    }


def test_decisions_are_numbered_by_owner_and_id(spark):
    pick = random.Random(5)
    mods, comps = pick.sample(range(-50, 50), 12), pick.sample(range(-50, 50), 20)
    inside = {c: pick.choice([*mods, 99]) for c in comps}
    said = [(i, pick.choice([None, 98, *mods]), pick.choice([None, 97, *comps]), f"t{i}") for i in pick.sample(range(-500, 500), 400)]
    row = lambda section, **of: (json.dumps({"section": section, "row": of}),)
    lines = [row("modules", module_id=m, name=f"m{m}") for m in mods] + [row("components", component_id=c, module_id=m, name=f"c{c}") for c, m in inside.items()]
    lines += [row("decisions", decision_id=i, module_id=m, component_id=c, text=t) for i, m, c, t in said]
    pick.shuffle(lines)
    tables, _ = maptables.read_sections(cut(spark.createDataFrame(lines, "value string").repartition(5), "lines"))
    got = sorted(tuple(r) for r in maptables.import_tables(tables)["decisions"].select("decision_id", "module_id", "component_id", "text").collect())
    new_m = {m: n for n, m in enumerate(sorted(mods), 1)}
    new_c = {c: n for n, c in enumerate(sorted((c for c in comps if inside[c] in new_m), key=lambda c: (inside[c], c)), 1)}
    want = sorted((0, new_m[m], i, new_m[m], None, t) for i, m, c, t in said if m in new_m) + sorted((1, new_c[c], i, None, new_c[c], t) for i, m, c, t in said if c in new_c)
    assert got == [(n, m, c, t) for n, (_, _, _, m, c, t) in enumerate(want, 1)]


def test_line_items_are_not_shuffled_for_customers(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        edges = views.component_edges(spark, "/root/testdata/sf0.001")
        plan = spark._jvm.PythonSQLUtils.explainString(edges._jdf.queryExecution(), "formatted")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    # By order, then by supplier.
    assert len(re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[[^\]]*l_suppkey", plan)) == 2
