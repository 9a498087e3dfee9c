"""Documents of any size as ordered fragments: no row, task or group holds a whole one.

A fragment is a piece of text with a key (an array of longs, then a text) that says where it belongs. Fragments are
sorted by ranges and numbered; the separator before one hangs on the fragment before it alone. Written as text parts in
order, one a line, they are the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.operators.maptables import MODULE_FIELDS, Tables, export_edges, with_module_fields
from depweave.operators.spread import spread_join
from depweave.sources.scratch import cut, numbered

_NONE = {"ignoreNullFields": "false"}


def fragment(rows: DataFrame, key: Sequence[Column | int], text: Column, tie: Column | None = None, item: bool = False, opens: bool = False) -> DataFrame:
    """key, tie, text, item, opens: a fragment a row. ``item``: a comma goes before it, unless the fragment before it
    ``opens`` a list."""
    parts = [(x if isinstance(x, Column) else F.lit(x)).cast("long") for x in key]
    return rows.select(F.array(*parts).alias("key"), (F.lit("") if tie is None else tie).alias("tie"), text.alias("text"), F.lit(item).alias("item"), F.lit(opens).alias("opens"))


def in_order(fragments: DataFrame) -> DataFrame:
    """pos (from 1), text of the fragments, with commas between the items of a list."""
    rows = cut(numbered(fragments, ["key", "tie", "text"], "pos").select("pos", "text", "item", "opens"), "fragments")
    before = rows.select((F.col("pos") + 1).alias("pos"), F.col("opens").alias("_opened"))
    out = rows.join(before, "pos", "left")
    return out.select("pos", F.when(F.col("item") & ~F.coalesce("_opened", F.lit(False)), F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("text"))


def map_fragments(tables: Tables, version: int | None = 1) -> DataFrame:
    """pos, text: the map as one JSON document (S9, J12), what ``export_map`` has in one row: modules with directories,
    decisions and components, these with files and decisions, in id order; then both kinds of edges. With ``version`` in
    the published form ``{"version": .., "map": ..}``. Children of unknown owners are left out; null fields are null.
    """
    every = tables["modules"].sparkSession.range(1)
    as_json = lambda *columns: F.to_json(F.struct(*columns), _NONE)
    open_json = lambda *columns: F.regexp_replace(as_json(*columns), r"\}$", "")
    mods = cut(with_module_fields(tables["modules"]).select("module_id", "name", "classification", *MODULE_FIELDS), "map-modules")
    known = mods.select("module_id").distinct()
    comps = cut(spread_join(cut(tables["components"], "map-components"), known, "module_id"), "map-components")
    owner = comps.select("component_id", F.col("module_id").alias("of"))
    d = cut(tables["decisions"].select("decision_id", "module_id", "component_id", "category", "text", "detail", "source"), "map-decisions")
    said = as_json(F.col("decision_id").alias("id"), "category", "text", "detail", "source")
    of_module = spread_join(d.where("module_id is not null").drop("component_id"), known, "module_id", counted=d.where("module_id is not null"))
    deep = d.where("component_id is not null").drop("module_id")
    of_component = spread_join(deep, owner, "component_id")
    files = spread_join(cut(tables["component_files"].select("component_id", "path", F.coalesce(F.col("is_test").cast("boolean"), F.lit(False)).alias("is_test")), "map-files"), owner, "component_id")
    dirs = spread_join(cut(tables["module_directories"].select("module_id", "directory"), "map-directories"), known, "module_id")

    m, c, of = F.col("module_id"), F.col("component_id"), F.col("of")
    head, tail = ('{"version":%d,"map":{' % version, "}}") if version is not None else ("{", "}")
    parts = [
        fragment(every, [0], F.lit(head + '"modules":['), opens=True),
        fragment(mods, [1, m], F.concat(open_json(m.alias("id"), "name", "classification", *MODULE_FIELDS), F.lit(',"directories":[')), item=True, opens=True),
        fragment(dirs, [1, m, 1], F.regexp_replace(F.to_json(F.array("directory")), r"^\[|\]$", ""), F.col("directory"), item=True),
        fragment(mods, [1, m, 2], F.lit('],"decisions":['), opens=True),
        fragment(of_module, [1, m, 3, F.col("decision_id")], said, item=True),
        fragment(mods, [1, m, 4], F.lit('],"components":['), opens=True),
        fragment(comps, [1, m, 5, c], F.concat(open_json(c.alias("id"), "name", "purpose", "confidence"), F.lit(',"files":[')), item=True, opens=True),
        fragment(files, [1, of, 5, c, 1], as_json("path", "is_test"), F.col("path"), item=True),
        fragment(comps, [1, m, 5, c, 2], F.lit('],"decisions":['), opens=True),
        fragment(of_component, [1, of, 5, c, 3, F.col("decision_id")], said, item=True),
        fragment(comps, [1, m, 5, c, 4], F.lit("]}")),
        fragment(mods, [1, m, 6], F.lit("]}")),
        fragment(every, [2], F.lit('],"module_edges":['), opens=True),
        fragment(every, [4], F.lit('],"component_edges":['), opens=True),
        fragment(every, [6], F.lit("]" + tail)),
    ]
    for place, name in ((3, "module_edges"), (5, "component_edges")):
        e = export_edges(tables[name])
        parts.append(fragment(e, [place, F.col("source_id"), F.col("target_id")], as_json(*e.columns), F.col("edge_type"), item=True))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return in_order(out)


def write_document(fragments: DataFrame, path: str) -> None:
    """The fragments (pos, text) as text parts whose names are in the document's order; read one after the other they
    are the document, with an end of line after each fragment."""
    fragments.repartitionByRange("pos").sortWithinPartitions("pos").select("text").write.mode("overwrite").text(path)


def document_parts(spark: SparkSession, path: str) -> list[str]:
    """The parts' paths, in the document's order; through Hadoop, so any file system will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(str(f.getPath()) for f in found if f.getPath().getName().startswith("part-"))


def placed(lines: DataFrame, of: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``lines`` with their ``pos`` (from 1, gapless) in the document that the columns ``of`` name, by ``order``: what stands
    before a line is counted over sorted ranges, so no task holds a document. In this order, joined by ends of line, they
    are the document."""
    rows = cut(numbered(lines, [*of, *order], "_n").withColumn("_of", F.struct(*of)), "lines")
    starts = rows.groupBy("_of").agg(F.min("_n").alias("_start"))
    return spread_join(rows, starts, "_of").withColumn("pos", F.col("_n") - F.col("_start") + 1).drop("_n", "_of", "_start")


def decision_lines(decisions: DataFrame, by: str, heading: str = "####") -> DataFrame:
    """``by``, first, id, part, line, pos: decisions as Markdown by lines (F14): a heading a category (blank ones
    ``General``), a line a decision and a quoted line for each of its detail, an empty line after each decision and one more
    after a category (id null, part 1). In the order of ``pos`` an owner's lines are the body of ``render_decisions``:
    categories by their first decision, decisions by id."""
    category = F.when(F.trim(F.coalesce("category", F.lit(""))) == "", "General").otherwise(F.col("category"))
    rows = cut(decisions.select(by, category.alias("category"), F.col("decision_id").alias("id"), "text", "detail", "source"), "decision-lines")
    groups = rows.groupBy(by, "category").agg(F.min("id").alias("first"))
    said = F.concat(F.lit("- "), "text", F.lit(" *(source: "), F.coalesce("source", F.lit("unknown")), F.lit(")*"))
    quoted = F.transform(F.split("detail", "\n"), lambda x: F.concat(F.lit("  > "), x))
    lines = F.concat(F.array(said), F.when(F.coalesce("detail", F.lit("")) != "", quoted).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    body = spread_join(rows, groups, [by, "category"]).select(by, "first", F.lit(1).alias("_kind"), "id", F.posexplode(lines).alias("part", "line"))
    no_id = F.lit(None).cast(rows.schema["id"].dataType).alias("id")
    heads = groups.select(by, "first", F.lit(0).alias("_kind"), no_id, F.lit(0).alias("part"), F.concat(F.lit(f"{heading} "), "category").alias("line"))
    ends = groups.select(by, "first", F.lit(2).alias("_kind"), no_id, F.lit(1).alias("part"), F.lit("").alias("line"))
    return placed(heads.unionByName(body).unionByName(ends), [by], ["first", "_kind", "id", "part"]).drop("_kind")


def elevation_lines(decisions: DataFrame, components: DataFrame) -> DataFrame:
    """module_id, name, component_id, decision_id, line, pos: the module requests of ``elevation_requests`` by lines (F6), in
    the order of ``pos``: a heading a component (decision_id null), a line a decision, an empty line between components."""
    owner = components.select("component_id", "module_id", "name")
    rows = cut(spread_join(cut(decisions.drop("module_id"), "elevation"), owner, "component_id"), "elevation")
    owners = cut(rows.select("module_id", "name", "component_id").distinct(), "elevation-owners")
    many = owners.groupBy("module_id").agg(F.count("*").alias("k"), F.min(F.struct("name", "component_id")).alias("_first")).where("k > 1").drop("k")
    line = F.format_string("[%d] (%s) %s", "decision_id", "category", "text")
    body = rows.select("module_id", "name", "component_id", "decision_id", F.lit(2).alias("_kind"), line.alias("line"))
    heads = owners.withColumns({"decision_id": F.lit(None).cast(rows.schema["decision_id"].dataType), "_kind": F.lit(1), "line": F.concat(F.lit("## "), "name")})
    out = heads.unionByName(body).unionByName(heads.withColumns({"_kind": F.lit(0), "line": F.lit("")}))
    out = spread_join(cut(out, "elevation"), many, "module_id").where((F.col("_kind") > 0) | (F.struct("name", "component_id") != F.col("_first"))).drop("_first")
    return placed(out, ["module_id"], ["name", "component_id", "_kind", "decision_id"]).drop("_kind")


def validation_lines(components: DataFrame, files: DataFrame, decisions: DataFrame) -> DataFrame:
    """component_id, human, decision_id, line, pos, files: the decisions of ``validation_requests`` by lines (F8), generated
    ones and those of people apart, each in the order of ``pos``, and the number of files, for components that have decisions
    and files that are no tests."""
    counts = files.where("not is_test").select("component_id", "path").distinct().groupBy("component_id").agg(F.count("*").alias("files"))
    own = components.select("component_id").join(counts, "component_id")
    line = F.format_string("[%d] (%s) %s", "decision_id", "category", "text")
    rows = decisions.select("component_id", (F.col("source") == "human").alias("human"), "decision_id", line.alias("line"))
    rows = spread_join(cut(rows.where("component_id is not null"), "validation"), own, "component_id")
    return placed(rows, ["component_id", "human"], ["decision_id"])
