"""The architecture map as tables: import, export, ingestion, search, cascades.

Tables are a dict of DataFrames: modules, module_directories, components, component_files, module_edges,
component_edges, decisions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.paths import is_test
from depweave.operators.components import assign_new_tests
from depweave.operators.search import Lookup, add_texts, ascii_lower, narrowed, read_index
from depweave.operators.spread import spread_join
from depweave.operators.versions import decisions_with_names
from depweave.sources.scratch import cut, numbered

Tables = dict[str, DataFrame]


def eligible_modules(modules: DataFrame) -> DataFrame:
    """Modules that are analysed: no supporting assets, and in the repository."""
    return modules.where("classification <> 'supporting-asset' and source_origin = 'in-repo'")


def select_rows(table: DataFrame, **equal) -> DataFrame:
    """Rows with the given column values; None means null (W6). Filters reach the Parquet scan."""
    for column, value in equal.items():
        table = table.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return table


def component_worklist(modules: DataFrame, components: DataFrame, files: DataFrame) -> DataFrame:
    """Components of eligible modules with at least one file that is no test."""
    rows = components.join(eligible_modules(modules).select("module_id"), "module_id", "left_semi")
    return rows.join(files.where("not is_test").select("component_id"), "component_id", "left_semi")


_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _like(col: str, pattern: str) -> Column:
    """LIKE in any case of A-Z; ``%`` and ``_`` are wild, a backslash stands for itself."""
    pattern = pattern.translate(_SMALL).replace("\\", "\\\\")
    return F.coalesce(ascii_lower(col).like(f"%{pattern}%"), F.lit(False))


def index_entities(modules: DataFrame, components: DataFrame, decisions: DataFrame, path: str) -> dict[str, DataFrame]:
    """Indexes for ``search_entities``, by table; those at ``path`` grow by these rows."""
    tables = {"modules": (modules, "module_id", ["name"]), "components": (components, "component_id", ["name"]), "decisions": (decisions, "decision_id", ["text", "detail"])}
    for name, (rows, key, texts) in tables.items():
        add_texts(rows, key, texts, f"{path}/{name}")
    return {name: read_index(modules.sparkSession, f"{path}/{name}") for name in tables}


def search_entities(modules: DataFrame, components: DataFrame, decisions: DataFrame, text: str, indexes: dict[str, DataFrame] | None = None, how: Lookup | None = None) -> DataFrame:
    """entity_type, id, name, owner of modules, components and decisions whose name, text or detail is LIKE
    ``%text%`` in any case of A-Z (W8). With ``indexes`` (see ``index_entities``) only what may match is read and checked;
    what is found is the same."""
    owners, names = modules, components
    if indexes is not None:
        runs = re.split("[%_]", text.translate(_SMALL))
        modules = narrowed(modules, "module_id", indexes["modules"], runs, how)
        components = narrowed(components, "component_id", indexes["components"], runs, how)
        decisions = narrowed(decisions, "decision_id", indexes["decisions"], runs, how)
    m = modules.where(_like("name", text)).select(F.lit("module").alias("entity_type"), F.col("module_id").alias("id"), "name", F.lit("").alias("owner"))
    owner = owners.select("module_id", F.col("name").alias("owner"))
    c = components.where(_like("name", text)).join(owner, "module_id", "left").select(F.lit("component").alias("entity_type"), F.col("component_id").alias("id"), "name", F.coalesce("owner", F.lit("")).alias("owner"))
    hits = decisions.where(_like("text", text) | _like("detail", text))
    named = decisions_with_names(hits, names, owners)
    d = named.select(F.lit("decision").alias("entity_type"), F.col("decision_id").alias("id"), F.col("text").alias("name"), F.when(F.col("component_name") != "", F.col("component_name")).otherwise(F.col("module_name")).alias("owner"))
    return m.unionByName(c).unionByName(d)


def map_overview(modules: DataFrame, components: DataFrame, decisions: DataFrame) -> DataFrame:
    """module_id, name, classification, components and decisions (its own and its components')."""
    n = components.groupBy("module_id").agg(F.count("*").alias("components"))
    own = decisions.join(components.select("component_id", F.col("module_id").alias("_m")), "component_id", "left")
    d = own.groupBy(F.coalesce("module_id", "_m").alias("module_id")).agg(F.count("*").alias("decisions"))
    rows = modules.select("module_id", "name", "classification").join(n, "module_id", "left").join(d, "module_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("components", "decisions")})


def overview_totals(modules: DataFrame) -> DataFrame:
    """classification and its modules."""
    return modules.groupBy("classification").agg(F.count("*").alias("modules"))


def delete_components(tables: Tables, ids: DataFrame) -> Tables:
    """All tables without the components (component_id) and what hangs on them."""
    ids = ids.select("component_id").distinct()
    gone = lambda t, c: t.join(ids.select(F.col("component_id").alias(c)), c, "left_anti").select(t.columns)
    edges = gone(gone(tables["component_edges"], "source_id"), "target_id")
    return tables | {"components": gone(tables["components"], "component_id"), "component_files": gone(tables["component_files"], "component_id"), "component_edges": edges, "decisions": gone(tables["decisions"], "component_id")}


def delete_modules(tables: Tables, ids: DataFrame) -> Tables:
    """All tables without the modules (module_id), their directories, components, edges and decisions."""
    ids = ids.select("module_id").distinct()
    gone = lambda t, c: t.join(ids.select(F.col("module_id").alias(c)), c, "left_anti").select(t.columns)
    out = delete_components(tables, tables["components"].join(ids, "module_id", "left_semi"))
    return out | {
        "modules": gone(out["modules"], "module_id"),
        "module_directories": gone(out["module_directories"], "module_id"),
        "module_edges": gone(gone(out["module_edges"], "source_id"), "target_id"),
        "decisions": gone(out["decisions"], "module_id"),
    }


def move_files(component_files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files moved to ``target_id``, where component and path both match (J18). ``moves``: component_id, path,
    target_id."""
    return component_files.join(moves, ["component_id", "path"], "left").withColumn("component_id", F.coalesce("target_id", "component_id")).select(component_files.columns)


def resolve_edge_ids(edges: DataFrame, ids: DataFrame, drop_loops: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges with source_id and target_id, skipped edges with an unknown end) (J11). ``ids``: name, id."""
    rows = edges
    for end in ("source", "target"):
        rows = rows.join(ids.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")), end, "left")
    known = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    loop = (F.col("source_id") == F.col("target_id")) if drop_loops else F.lit(False)
    return rows.where(known & ~loop), rows.where(~known | (known & loop)).select(edges.columns)


def _metadata(col: str = "metadata") -> Column:
    """Metadata as JSON text in one spelling; ``{}`` where it is missing or no JSON object."""
    text = F.when(F.try_parse_json(col).isNotNull() & F.ltrim(F.col(col)).startswith("{"), F.to_json(F.try_parse_json(col)))
    return F.coalesce(text, F.lit("{}"))


#: What a module has besides its name and classification.
MODULE_FIELDS = ["type", "technology", "source_origin", "deployment_target"]


def with_module_fields(table: DataFrame) -> DataFrame:
    """Modules with all their fields, null where the table lacks one."""
    return table.select("module_id", "name", "classification", *(F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in MODULE_FIELDS))


def _listed(rows: DataFrame, by: str, fields: Sequence[Column | str], out: str) -> DataFrame:
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))


def export_modules(tables: Tables) -> DataFrame:
    """A row a module: id and fields, directories, decisions, components with their files and decisions.
    Children without rows are empty arrays; everything is in id order."""
    c, d = tables["components"], tables["decisions"]
    fields = [F.col("decision_id").alias("id"), "category", "text", "detail", "source"]
    files = _listed(tables["component_files"], "component_id", ["path", F.coalesce(F.col("is_test").cast("boolean"), F.lit(False)).alias("is_test")], "files")
    of_component = _listed(d.where("component_id is not null"), "component_id", fields, "decisions")
    c = c.join(files, "component_id", "left").join(of_component, "component_id", "left")
    none = lambda name: F.coalesce(F.col(name), F.array())
    c = _listed(c, "module_id", [F.col("component_id").alias("id"), "name", "purpose", "confidence", none("files").alias("files"), none("decisions").alias("decisions")], "components")
    dirs = tables["module_directories"].groupBy("module_id").agg(F.array_sort(F.collect_list("directory")).alias("directories"))
    of_module = _listed(d.where("module_id is not null"), "module_id", fields, "decisions")
    m = with_module_fields(tables["modules"]).join(dirs, "module_id", "left").join(of_module, "module_id", "left").join(c, "module_id", "left")
    return m.select(F.col("module_id").alias("id"), "name", "classification", *MODULE_FIELDS, none("directories").alias("directories"), none("decisions").alias("decisions"), none("components").alias("components"))


def export_edges(edges: DataFrame) -> DataFrame:
    """Edges as they stand in a map: metadata is the text of a JSON object, ``{}`` where it isn't one."""
    return edges.select("source_id", "target_id", "edge_type", "weight", _metadata().alias("metadata"))


def export_map(tables: Tables) -> DataFrame:
    """One row: the map as one document with modules, module_edges, component_edges (J12). A document is one value, so
    it must fit one; ``export_modules`` and ``export_edges`` have the same as tables of any size."""
    every = lambda rows, out: rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(out))
    m = every(export_modules(tables), "modules")
    for name in ("module_edges", "component_edges"):
        m = m.join(F.broadcast(every(export_edges(tables[name]), name)))
    return m


def map_sizes(tables: Tables) -> DataFrame:
    """One row a component (a module without any has one row too): what the nested map holds, as counts per
    component and module and the module's directories; no list of children is made."""
    d = tables["decisions"]
    count = lambda rows, by, out: rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias(out))
    dirs = tables["module_directories"].groupBy("module_id").agg(F.array_join(F.array_sort(F.collect_list("directory")), ",").alias("directories"))
    c = tables["components"].select("module_id", "component_id", F.col("name").alias("component"))
    c = c.join(count(tables["component_files"], "component_id", "files"), "component_id", "left").join(count(d, "component_id", "decisions"), "component_id", "left")
    m = tables["modules"].select("module_id", "name").join(dirs, "module_id", "left").join(count(d, "module_id", "module_decisions"), "module_id", "left").join(c, "module_id", "left")
    none = {n: F.coalesce(n, F.lit(0)) for n in ("files", "decisions", "module_decisions")}
    return m.withColumns(none | {"directories": F.coalesce("directories", F.lit(""))}).select("module_id", "name", "component_id", "component", "files", "decisions", "module_decisions", "directories")


#: The tables of a map with their columns, as its sections have them.
SECTIONS = {
    "modules": "module_id long, name string, classification string, type string, technology string, source_origin string, deployment_target string",
    "module_directories": "module_id long, directory string",
    "components": "component_id long, module_id long, name string, purpose string, confidence double",
    "component_files": "component_id long, path string, is_test boolean",
    "decisions": "decision_id long, module_id long, component_id long, category string, text string, detail string, source string",
    "module_edges": "source_id long, target_id long, edge_type string, weight double, metadata string",
    "component_edges": "source_id long, target_id long, edge_type string, weight double, metadata string",
}


def map_sections(tables: Tables) -> DataFrame:
    """value: the map by sections, a line of JSON a row of its tables, ``{"section": .., "row": {..}}`` (S9); what
    ``read_sections`` takes in. Lines may come in any order and file, so a map may be of any size."""
    out = None
    for name, schema in SECTIONS.items():
        table = with_module_fields(tables[name]) if name == "modules" else tables[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = table.select(F.to_json(F.struct(F.lit(name).alias("section"), F.struct(*columns).alias("row"))).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_sections(lines: DataFrame) -> tuple[Tables, DataFrame]:
    """(tables, errors) of a map that comes by sections (``value``) (S7, J13): what ``import_tables`` takes. A missing
    classification is ``module``, a decision's missing source ``pipeline_generated``, an edge's missing weight 1. errors:
    value, reason of lines that are no section."""
    # Null where the line is no JSON or has no such text.
    section = F.try_variant_get(F.try_parse_json("value"), "$.section", "string")
    missing = {"classification": F.lit("module"), "source": F.lit("pipeline_generated"), "weight": F.lit(1.0), "is_test": F.lit(False)}
    row = {name: F.from_json("value", f"row struct<{schema.replace(' ', ': ').replace(',: ', ', ')}>")["row"] for name, schema in SECTIONS.items()}
    # A line is parsed once and written with a column a section, so a table reads its own column, not all lines again.
    of = F.col("section")
    known = F.coalesce(of.isin(*SECTIONS), F.lit(False))
    rows = lines.select("value", section.alias("section"))
    rows = cut(rows.select(F.when(known, of).alias("section"), F.when(~known, F.col("value")).alias("value"), *(F.when(of == name, row[name]).alias(name) for name in SECTIONS)), "sections-read")
    tables = {}
    for name in SECTIONS:
        table = rows.where(of == name).select(f"{name}.*")
        tables[name] = table.withColumns({c: F.coalesce(c, v) for c, v in missing.items() if c in table.columns})
    return tables, rows.where(of.isNull()).select("value", F.lit("no section").alias("reason"))


def import_map(nested: DataFrame) -> Tables:
    """Tables of a nested map with new ids from 1 in the old ids' order (J13); see ``import_tables``. A missing
    classification is ``module``, a decision's missing source ``pipeline_generated``, an edge's missing weight 1."""
    mods = nested.select(F.explode("modules").alias("m")).select("m.*")
    comps = mods.select(F.col("id").alias("module_id"), F.explode("components").alias("c")).select("module_id", "c.*")
    field = [F.col("x.id").alias("decision_id"), "x.category", "x.text", "x.detail", F.coalesce("x.source", F.lit("pipeline_generated")).alias("source")]
    own = mods.select(F.col("id").alias("module_id"), F.lit(None).cast("long").alias("component_id"), F.explode("decisions").alias("x"))
    deep = comps.select(F.lit(None).cast("long").alias("module_id"), F.col("id").alias("component_id"), F.explode("decisions").alias("x"))
    edges = lambda name: nested.select(F.explode(name).alias("e")).select("e.source_id", "e.target_id", "e.edge_type", F.coalesce("e.weight", F.lit(1.0)).alias("weight"), "e.metadata")
    return import_tables({
        "modules": mods.select(F.col("id").alias("module_id"), "name", F.coalesce("classification", F.lit("module")).alias("classification"), *MODULE_FIELDS),
        "module_directories": mods.select(F.col("id").alias("module_id"), F.explode("directories").alias("directory")),
        "components": comps.select(F.col("id").alias("component_id"), "module_id", "name", "purpose", "confidence"),
        "component_files": comps.select(F.col("id").alias("component_id"), F.explode("files").alias("f")).select("component_id", "f.path", F.coalesce("f.is_test", F.lit(False)).alias("is_test")),
        "decisions": own.unionByName(deep).select("module_id", "component_id", *field),
        "module_edges": edges("module_edges"),
        "component_edges": edges("component_edges"),
    })


#: Taken from a module's number for its place among owners; there are fewer owners than this.
_AHEAD = 1 << 62


def import_tables(tables: Tables) -> Tables:
    """The flat tables of a map with new ids from 1 in the old ids' order (J13). Children hang on their new
    owners and go where those are unknown; a decision of a module and a component comes for both, as in the
    nested map. Edges stay only if both ends are known; of edges that repeat (source, target, type) the first
    stays."""
    # Numbers are written once more, so that the planner knows how small they are: it broadcasts few and shuffles many.
    mods = cut(numbered(with_module_fields(tables["modules"]).withColumnRenamed("module_id", "id"), ["id", "name"], "module_id"), "import-modules")
    new_mod = mods.select(F.col("id").alias("_old"), F.col("module_id").alias("_new"))
    child = lambda name, key, new: tables[name].join(new, F.col(key) == F.col("_old")).withColumn(key, F.col("_new")).drop("_old", "_new")
    comps = cut(numbered(child("components", "module_id", new_mod).withColumnRenamed("component_id", "id"), ["module_id", "id", "name"], "component_id"), "import-components")
    new_comp = comps.select(F.col("id").alias("_old"), F.col("component_id").alias("_new"))
    # Decisions are read once for both kinds of owners; only a decision of both becomes two rows. A place orders modules
    # before components, so rows are sorted by two numbers.
    owner = lambda deep, key: F.struct(F.lit(deep).alias("_deep"), F.col(key).alias("_old"))
    own, deep = owner(False, "module_id"), owner(True, "component_id")
    both = F.when(F.col("component_id").isNull(), F.array(own)).when(F.col("module_id").isNull(), F.array(deep)).otherwise(F.array(own, deep))
    rows = tables["decisions"].select(F.col("decision_id").alias("id"), "category", "text", "detail", "source", F.explode(both).alias("o")).select("id", "category", "text", "detail", "source", "o.*")
    placed = lambda new, deep, ahead: new.select(F.lit(deep).alias("_deep"), "_old", (F.col("_new") - ahead).alias("_place"))
    owners = cut(placed(new_mod, False, _AHEAD).unionByName(placed(new_comp, True, 0)), "import-owners")
    decisions = numbered(rows.join(owners, ["_deep", "_old"]).drop("_deep", "_old"), ["_place", "id"], "decision_id")
    of_module = F.col("_place") < 0
    decisions = decisions.select("decision_id", F.when(of_module, F.col("_place") + _AHEAD).alias("module_id"), F.when(~of_module, F.col("_place")).alias("component_id"), "category", "text", "detail", "source")

    def edges(name: str, ids: DataFrame) -> DataFrame:
        rows = tables[name].withColumn("metadata", _metadata())
        for end in ("source_id", "target_id"):
            rows = rows.join(ids.select(F.col("_old").alias(end), F.col("_new").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
        first = Window.partitionBy("source_id", "target_id", "edge_type").orderBy(F.desc("weight"), "metadata")
        return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("source_id", "target_id", "edge_type", "weight", "metadata")

    return {
        "modules": mods.select("module_id", "name", "classification", *MODULE_FIELDS),
        "module_directories": child("module_directories", "module_id", new_mod).select("module_id", "directory"),
        "components": comps.select("component_id", "module_id", "name", "purpose", "confidence"),
        "component_files": child("component_files", "component_id", new_comp).select("component_id", "path", "is_test"),
        "decisions": decisions,
        "module_edges": edges("module_edges", new_mod),
        "component_edges": edges("component_edges", new_comp),
    }


def table_counts(tables: Tables) -> DataFrame:
    """table_name, n."""
    out = None
    for name, table in sorted(tables.items()):
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def with_edge_label(edges: DataFrame, defaults: bool = False) -> DataFrame:
    """Edges with label and JSON metadata by type (P15). ``edges``: target_name, edge_type, protocol, description; with
    ``defaults`` also source_name, and a blank description says what the label says."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    protocol, kind = blank("protocol"), F.col("edge_type")
    via, stores = kind == "communicates_via", kind == "uses_data_store"
    label = F.when(via, F.concat(F.when(protocol != "", F.concat(protocol, F.lit(": "))).otherwise("calls "), "target_name"))
    label = label.when(stores, F.concat(F.lit("stores data in "), "target_name")).otherwise(F.concat(F.lit("uses "), "target_name"))
    description = blank("description")
    if defaults:
        usual = F.when(stores, F.concat(F.lit("Connects to "), "target_name")).otherwise(F.concat("source_name", F.lit(" depends on "), "target_name"))
        description = F.when(~via & (description == ""), usual).otherwise(description)
    rows = edges.withColumn("label", label)
    body = F.when(via, F.to_json(F.struct("label", protocol.alias("protocol"), description.alias("description")))).otherwise(F.to_json(F.struct("label", description.alias("description"))))
    return rows.withColumn("metadata", body)


_RELATION = "struct<targetModuleId string, type string, protocol string, description string>"

#: A module document of an ingestion; relationships are a list of relations or, of old, lists by kind.
MODULES = (
    "modules array<struct<id string, name string, classification string, type string, technology string, sourceOrigin string, deploymentTarget string, "
    "directories array<string>, relationships string, consumedBy array<string>>>"
)
OLD_RELATIONS = f"struct<dependsOnModules array<string>, usesDataStores array<string>, communicatesVia array<{_RELATION}>>"

#: An edge document of an ingestion.
EDGES = "edges array<struct<sourceId string, targetId string, type string, protocol string, description string>>, consumedBy array<struct<libraryId string, consumerIds array<string>>>"


#: A module by itself, as a section of an ingestion.
_SECTION = MODULES.removeprefix("modules array<struct<").removesuffix(">>")


def ingest_modules(doc: DataFrame) -> Tables:
    """modules (module_id, key, fields, consumedBy, relationships) and module_directories of a document (``value``).
    Ids are given in the document's order; ``codebase/`` goes from the start of directories."""
    rows = doc.select(F.from_json("value", MODULES).alias("d")).select(F.posexplode("d.modules").alias("ord", "m")).select("ord", "m.*")
    return _module_tables(rows)


def ingest_sections(sections: DataFrame) -> Tables:
    """``ingest_modules`` of a document that comes in sections: a row (ord, ``value``) a module, so that a document may be
    of any size. Rows that are no JSON object are left out."""
    rows = sections.where(F.try_parse_json("value").isNotNull()).select("ord", F.from_json("value", _SECTION).alias("m")).select("ord", "m.*")
    return _module_tables(rows)


def _module_tables(rows: DataFrame) -> Tables:
    rows = rows.where("name is not null or id is not null")
    rows = numbered(rows.withColumn("key", F.coalesce("id", "name")), ["ord", "key"], "module_id")
    mods = rows.select(
        "module_id", "key", F.coalesce("name", "id").alias("name"), F.coalesce("classification", F.lit("module")).alias("classification"), "type", "technology",
        F.col("sourceOrigin").alias("source_origin"), F.col("deploymentTarget").alias("deployment_target"), "directories", "relationships", "consumedBy",
    )
    dirs = mods.select("module_id", F.explode("directories").alias("directory")).select("module_id", F.regexp_replace("directory", "^codebase/", "").alias("directory")).distinct()
    return {"modules": mods, "module_directories": dirs}


def _named_ends(rows: DataFrame, mods: DataFrame) -> DataFrame:
    """Edges (source, target as keys) between known modules, with ids and names."""
    for end in ("source", "target"):
        known = mods.select(F.col("key").alias(end), F.col("module_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
        rows = spread_join(cut(rows, "ends"), known, end)  # a module that all others use is dealt over tasks
    return rows


def _first_edges(rows: DataFrame) -> DataFrame:
    """The first edge of each (source, target, type): declared ones in their order, then fillers."""
    first = Window.partitionBy("source_id", "target_id", "edge_type").orderBy("filler", "ord", "n")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("source_id", "target_id", "edge_type", F.lit(1.0).alias("weight"), "metadata")


def ingest_modules_single(doc: DataFrame) -> Tables:
    """modules, module_directories, module_edges of one document (``value``) with modules and their relationships.

    Relations go by targetModuleId; those to unknown modules are dropped and the first of a (source, target, type)
    stays. ``consumedBy`` of shared libraries adds a ``depends_on`` edge where there is none of that type."""
    return with_module_edges(ingest_modules(doc))


def with_module_edges(tables: Tables) -> Tables:
    """The tables of ``ingest_modules`` or ``ingest_sections`` with module_edges from their modules' relationships."""
    mods = tables["modules"]
    as_list = F.from_json("relationships", f"array<{_RELATION}>")
    old = F.from_json("relationships", OLD_RELATIONS)
    simple = lambda c, kind, what: F.transform(F.coalesce(old[c], F.array().cast("array<string>")), lambda t: F.struct(t.alias("targetModuleId"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("protocol"), F.concat(F.lit(what), t).alias("description")))
    via = F.transform(F.coalesce(old["communicatesVia"], F.array().cast(f"array<{_RELATION}>")), lambda c: F.struct(c["targetModuleId"].alias("targetModuleId"), F.lit("communicates_via").alias("type"), c["protocol"].alias("protocol"), c["description"].alias("description")))
    of_old = F.concat(simple("dependsOnModules", "depends_on", "Depends on "), simple("usesDataStores", "uses_data_store", "Stores data in "), via)
    relations = F.when(F.ltrim("relationships").startswith("{"), of_old).otherwise(as_list)
    declared = mods.select(F.col("key").alias("source"), F.col("module_id").alias("ord"), F.posexplode(relations).alias("n", "r"))
    declared = declared.select("source", "ord", "n", F.col("r.targetModuleId").alias("target"), F.coalesce("r.type", F.lit("depends_on")).alias("edge_type"), "r.protocol", "r.description", F.lit(0).alias("filler"))
    declared = with_edge_label(_named_ends(declared, mods), defaults=True)
    fillers = mods.where("classification = 'shared-library'").select(F.col("key").alias("target"), F.col("module_id").alias("ord"), F.posexplode("consumedBy").alias("n", "source"))
    fillers = _named_ends(fillers.select("source", "target", "ord", "n", F.lit("depends_on").alias("edge_type"), F.lit(1).alias("filler")), mods)
    fillers = fillers.withColumn("metadata", F.to_json(F.struct(F.concat(F.lit("uses "), "target_name").alias("label"), F.concat("source_name", F.lit(" imports "), "target_name").alias("description"))))
    cols = ["source_id", "target_id", "edge_type", "filler", "ord", "n", "metadata"]
    return {"modules": mods.drop("directories", "relationships", "consumedBy"), "module_directories": tables["module_directories"], "module_edges": _first_edges(declared.select(cols).unionByName(fillers.select(cols)))}


def ingest_edges(doc: DataFrame, mods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(module_edges, skipped) of a second document (``value``) with edges and consumedBy (J24). ``mods``: module_id, key,
    name. Edges with an unknown end and loops are skipped, the first of a (source, target, type) stays, and consumers of
    a library get a ``depends_on`` edge where there is none of that type. ``skipped``: sourceId, targetId."""
    parsed = doc.select(F.from_json("value", EDGES).alias("d"))
    rows = parsed.select(F.posexplode("d.edges").alias("ord", "e")).select("ord", "e.*")
    rows = rows.select("ord", F.col("sourceId").alias("source"), F.col("targetId").alias("target"), F.coalesce("type", F.lit("depends_on")).alias("edge_type"), "protocol", "description", F.lit(0).alias("filler"), F.lit(0).alias("n"))
    known = mods.select(F.col("key").alias("name"), F.col("module_id").alias("id"))
    good, bad = resolve_edge_ids(rows, known, drop_loops=True)
    edges = with_edge_label(good.join(mods.select(F.col("module_id").alias("target_id"), F.col("name").alias("target_name")), "target_id"))
    more = parsed.select(F.posexplode("d.consumedBy").alias("ord", "c")).select("ord", F.col("c.libraryId").alias("target"), F.posexplode("c.consumerIds").alias("n", "source"))
    more = _named_ends(more.withColumns({"edge_type": F.lit("depends_on"), "filler": F.lit(1)}), mods)
    more = more.withColumn("metadata", F.to_json(F.struct(F.concat(F.lit("uses "), "target_name").alias("label"))))
    cols = ["source_id", "target_id", "edge_type", "filler", "ord", "n", "metadata"]
    skipped = bad.where("source <> '' and target <> ''").select(F.col("source").alias("sourceId"), F.col("target").alias("targetId"))
    return _first_edges(edges.select(cols).unionByName(more.select(cols))), skipped


def module_neighbours(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """module_id, direction (depends_on, used_by), neighbour name, edge_type (J15); an unknown id is
    ``Module #id``."""
    names = modules.select(F.col("module_id").alias("other"), "name")
    one = lambda a, b, how: edges.select(F.col(a).alias("module_id"), F.col(b).alias("other"), F.lit(how).alias("direction"), "edge_type")
    rows = one("source_id", "target_id", "depends_on").unionByName(one("target_id", "source_id", "used_by"))
    return rows.join(names, "other", "left").select("module_id", "direction", F.coalesce("name", F.concat(F.lit("Module #"), F.col("other").cast("string"))).alias("neighbour"), "edge_type")


def apply_classification(new_files: DataFrame, components: DataFrame, responses: DataFrame, new_confidence: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(component_files, new components, stats) from new files (module_id, path) and their responses.

    ``responses``: module_id, path, existing_component, new_component, purpose. A file goes to the named existing
    component of its module; else to the proposed new one, which is made once and takes the purpose of the first file
    (by path) that names it; else nowhere, so that an unknown existing name makes nothing. Test files aren't asked
    about: they follow ``assign_new_tests``. ``stats``: new_files_found, files_assigned, components_created,
    orphan_files. ``components``: module_id, component_id, name."""
    new_files = new_files.select("module_id", "path").distinct()
    sources, tests = new_files.where(~is_test("path")), new_files.where(is_test("path"))
    answers = responses.join(sources, ["module_id", "path"], "left_semi").groupBy("module_id", "path").agg(*(F.min(c).alias(c) for c in ("existing_component", "new_component", "purpose")))
    known = components.select("module_id", "name", "component_id")
    wanted = answers.join(known.select("module_id", F.col("name").alias("existing_component"), F.lit(True).alias("_known")), ["module_id", "existing_component"], "left")
    proposed = F.when(F.coalesce(F.col("new_component"), F.lit("")) != "", F.col("new_component"))
    wanted = wanted.withColumn("name", F.when(F.col("_known"), F.col("existing_component")).otherwise(proposed)).where("name is not null")
    fresh = wanted.join(known, ["module_id", "name"], "left_anti").groupBy("module_id", "name").agg(F.min_by("purpose", "path").alias("purpose"))
    top = components.agg(F.coalesce(F.max("component_id"), F.lit(0)).alias("_top"))
    fresh = numbered(fresh, ["module_id", "name"], "_n").join(F.broadcast(top))
    fresh = cut(fresh.select((F.col("_top") + F.col("_n")).cast("long").alias("component_id"), "module_id", "name", F.coalesce("purpose", F.lit("")).alias("purpose"), F.lit(new_confidence).alias("confidence")), "new-components")
    every = known.unionByName(fresh.select("module_id", "name", "component_id"))
    own = cut(wanted.join(every, ["module_id", "name"]).select("component_id", "path").distinct(), "classified")
    followed = assign_new_tests(tests, own.select("path", F.col("component_id").alias("component")), known.withColumnRenamed("component_id", "component"))
    files = own.withColumn("is_test", F.lit(False)).unionByName(followed.select(F.col("component").alias("component_id"), "path", F.lit(True).alias("is_test")))
    files = cut(files.distinct(), "classified")
    one = lambda rows, out: F.broadcast(rows.agg(F.count("*").alias(out)))
    stats = one(new_files, "new_files_found").join(one(files, "files_assigned")).join(one(fresh, "components_created"))
    return files, fresh, stats.withColumn("orphan_files", F.col("new_files_found") - F.col("files_assigned"))


def _as_text(v: str, field: str) -> Column:
    """A field of a variant as text: a list becomes lines, what is missing or false becomes empty."""
    lines = F.array_join(F.try_variant_get(v, f"$.{field}", "array<string>"), "\n")
    return F.coalesce(lines, F.try_variant_get(v, f"$.{field}", "string"), F.lit(""))


def build_tickets(responses: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tickets, files, links, stats) from responses (C11): request_id, json, the text of a list of tickets.

    Tickets are numbered in order; title, description and acceptance_criteria may be texts or lists, affected_files a
    text or a list. Map corrections are only counted. Links only go to existing change records (change_id)."""
    every = responses.select("request_id", F.posexplode(F.from_json("json", "array<string>")).alias("n", "t"))
    every = every.select("request_id", "n", F.try_parse_json("t").alias("v"))
    correction = F.coalesce(F.try_variant_get("v", "$.is_map_correction", "boolean"), F.lit(False))
    rows = cut(every.select(
        "request_id", "n", correction.alias("correction"), *(_as_text("v", c).alias(c) for c in ("title", "description", "acceptance_criteria")),
        F.coalesce(F.try_variant_get("v", "$.affected_files", "array<string>"), F.array(F.try_variant_get("v", "$.affected_files", "string"))).alias("files"),
        F.try_variant_get("v", "$.change_record_ids", "array<bigint>").alias("change_ids"),
    ), "tickets")
    real = cut(numbered(rows.where("not correction"), ["request_id", "n"], "ticket_id"), "tickets")
    files = real.select("ticket_id", F.explode("files").alias("path")).where("path <> ''").distinct()
    links = real.select("ticket_id", F.explode("change_ids").alias("change_id")).distinct().join(changes.select("change_id"), "change_id", "left_semi").select("ticket_id", "change_id")
    stats = rows.agg(F.count_if(~F.col("correction")).alias("tickets"), F.count_if("correction").alias("map_corrections"))
    return real.select("ticket_id", "title", "description", "acceptance_criteria"), files, links, stats


def tickets_with_files(tickets: DataFrame, files: DataFrame) -> DataFrame:
    """Tickets with their files, an empty array without any."""
    own = files.groupBy("ticket_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return tickets.join(own, "ticket_id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def link_ticket_decisions(links: DataFrame, new: DataFrame) -> DataFrame:
    """Ticket-decision links with the new ones, each once."""
    return links.unionByName(new.select(links.columns)).distinct()


def flag_nodes(nodes: DataFrame, changes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Nodes (kind, id) with changed and revalidated (A26). ``changes``, ``outcomes``: module_id, component_id;
    outcomes also status."""
    def owners(rows: DataFrame, flag: str) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit("module").alias("kind"), F.col("module_id").alias("id")), F.struct(F.lit("component").alias("kind"), F.col("component_id").alias("id"))))
        return rows.select(both.alias("o")).select("o.*").where("id is not null").distinct().withColumn(flag, F.lit(True))

    rows = nodes.join(owners(changes, "changed"), ["kind", "id"], "left")
    rows = rows.join(owners(outcomes.where(~F.col("status").isin("confirmed", "unchanged")), "revalidated"), ["kind", "id"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("changed", "revalidated")})


def group_decisions(decisions: DataFrame, by: str = "category", blank: str = "General") -> DataFrame:
    """group, decision_id, text: decisions with their group, to be listed by group and id (A25); a blank category is
    ``General``. A group may hold any number of decisions, so it isn't made one row."""
    key = F.when(F.trim(F.coalesce(F.col(by).cast("string"), F.lit(""))) == "", blank).otherwise(F.col(by).cast("string"))
    return decisions.select(key.alias("group"), "decision_id", "text")
