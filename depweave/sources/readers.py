"""Reading decoded indexes, source trees and maps; writing tables and documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.functions.paths import exclude_globs, extension, leaf, parent

#: A decoded index as nested records.
INDEX = (
    "index_id string, project_root string, tool_name string, tool_version string, documents array<struct<relative_path string, language string, text string, "
    "occurrences array<struct<symbol string, symbol_roles int, range array<int>>>, symbols array<struct<symbol string, kind int, display_name string, "
    "relationships array<struct<symbol string, is_implementation boolean, is_reference boolean, is_type_definition boolean, is_definition boolean>>>>>>"
)

_DECISIONS = "decisions array<struct<id long, category string, text string, detail string, source string>>"
_EDGES = "array<struct<source_id long, target_id long, edge_type string, weight double, metadata string>>"

#: A map as nested records. The metadata of an edge is an object, read as its text.
MAP = (
    "modules array<struct<id long, name string, classification string, type string, technology string, source_origin string, deployment_target string, directories array<string>, "
    f"{_DECISIONS}, components array<struct<id long, name string, purpose string, confidence double, files array<struct<path string, is_test boolean>>, {_DECISIONS}>>>>, "
    f"module_edges {_EDGES}, component_edges {_EDGES}"
)


@dataclass(frozen=True)
class IndexTables:
    indexes: DataFrame
    documents: DataFrame
    occurrences: DataFrame
    symbols: DataFrame
    relationships: DataFrame


def flatten_index(nested: DataFrame) -> IndexTables:
    """The flat tables of nested index records, with ordinals of what stood where."""
    docs = nested.select("index_id", F.posexplode("documents").alias("doc_ord", "d"))
    documents = docs.select("index_id", F.col("doc_ord").cast("long").alias("doc_ord"), "d.relative_path", "d.language", "d.text")
    occ = docs.select("index_id", "doc_ord", "d.relative_path", F.posexplode("d.occurrences").alias("occ_ord", "o"))
    sym = docs.select("index_id", "doc_ord", "d.relative_path", F.posexplode("d.symbols").alias("sym_ord", "s"))
    rel = sym.select("index_id", "relative_path", F.col("s.symbol").alias("symbol"), F.explode("s.relationships").alias("r"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return IndexTables(
        nested.select("index_id", "project_root", "tool_name", "tool_version"),
        documents,
        occ.select("index_id", long("doc_ord"), long("occ_ord"), "relative_path", "o.symbol", "o.symbol_roles", "o.range"),
        sym.select("index_id", long("doc_ord"), long("sym_ord"), "relative_path", "s.symbol", "s.kind", "s.display_name"),
        rel.select("index_id", "relative_path", "symbol", F.col("r.symbol").alias("target_symbol"), "r.is_implementation", "r.is_reference", "r.is_type_definition", "r.is_definition"),
    )


def read_index(spark: SparkSession, path: str, kind: str = "parquet") -> IndexTables:
    """Flat tables of decoded index records in Parquet or JSON lines."""
    return flatten_index(spark.read.schema(INDEX).format(kind).load(path))


def admit_files(files: DataFrame, max_bytes: int = 512 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected with reason): files that are there, not empty and not too large (S2). ``files``:
    path, length (null: missing)."""
    reason = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too large")
    rows = files.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def scan_permissive(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, quarantine, stats) of JSON lines: bad records are kept apart and counted (S3)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    return split_records(lines, schema)


def split_records(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same on a table of lines (``value``)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    stats = rows.agg(F.count("*").alias("records"), F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))
    return rows.where(~bad).select(*(F.col(f"r.{f.name}") for f in schema.fields)), rows.where(bad).select("value"), stats


def sanitize_utf8(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Invalid UTF-8 in string columns (or the given ones) becomes U+FFFD."""
    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.make_valid_utf8(c) for c in names})


def scan_files(spark: SparkSession, root: str, dirs: Sequence[str] | None = None, excludes: Sequence[str] = ()) -> DataFrame:
    """path (relative to the root), length, name, ext, hidden of a source tree, content unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{root}/{d}" for d in dirs] if dirs else root)
    base = root.rstrip("/") + "/"
    at = F.locate(base, F.col("path"))
    rows = files.select(F.substring("path", at + len(base), F.length("path")).alias("path"), "length")
    rows = rows.select("path", "length", leaf("path").alias("name"), extension("path").alias("ext"), F.startswith(leaf("path"), F.lit(".")).alias("hidden"))
    return exclude_globs(rows, excludes)


def read_map_json(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(maps, errors): each text is ``{"version": .., "map": {..}}`` or the bare map; a map must have ``modules``
    (S7)."""
    inner = F.from_json(column, f"map struct<{MAP}>")["map"]
    bare = F.from_json(column, MAP)
    rows = texts.select(F.col(column), F.when(inner.isNotNull(), inner).otherwise(bare).alias("m"))
    ok = F.coalesce(F.col("m.modules").isNotNull(), F.lit(False))
    return rows.where(ok).select("m.*"), rows.where(~ok).select(column, F.lit("no modules").alias("reason"))


def replace_scope(table: DataFrame, new: DataFrame, scope: Sequence[str]) -> DataFrame:
    """``table`` with every scope that ``new`` has replaced by its rows."""
    return table.join(new.select(*scope).distinct(), list(scope), "left_anti").select(table.columns).unionByName(new, allowMissingColumns=True).select(table.columns)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write, replacing just the partitions that ``df`` has: a repeated write changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_map_json(nested: DataFrame, path: str, version: int = 1) -> None:
    """One line ``{"version": .., "map": ..}`` a map, the metadata of edges as objects."""
    def edges(name: str):
        return F.transform(name, lambda e: F.struct(*(e[c].alias(c) for c in ("source_id", "target_id", "edge_type", "weight")), F.try_parse_json(e["metadata"]).alias("metadata"))).alias(name)

    whole = F.struct("modules", edges("module_edges"), edges("component_edges"))
    nested.select(F.to_json(F.struct(F.lit(version).alias("version"), whole.alias("map"))).alias("value")).write.text(path)


def write_docs(docs: DataFrame, path: str) -> None:
    """Text files under one folder for each document name (S10). ``docs``: file_name, text."""
    docs.select("file_name", F.col("text").alias("value")).write.partitionBy("file_name").mode("overwrite").text(path)


#: What tells of a deployment: fixed values.
DEPLOYMENT_FILES = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "package.json", "requirements.txt", "pyproject.toml", "Makefile", ".env.example", "Procfile", "vercel.json", "fly.toml"]
DEPLOYMENT_DIRS = ["config", "k8s", "helm"]
PACKAGE_KEYS = ["scripts", "dependencies", "devDependencies", "engines", "main", "type"]


def package_json(content: str = "content"):
    """Only the keys that matter for deployment; the first 4000 characters where it is no JSON object."""
    every = F.from_json(content, "map<string,string>")
    parsed = F.from_json(content, ", ".join(f"{k} string" if k in ("main", "type") else f"{k} map<string,string>" for k in PACKAGE_KEYS))
    return F.when(F.try_parse_json(content).isNotNull() & every.isNotNull(), F.to_json(parsed)).otherwise(F.substring(content, 1, 4000))


def select_deployment_files(files: DataFrame, module_dirs: DataFrame) -> DataFrame:
    """module_id, path, content of deployment files at the root and in module directories, and of YAML files in
    their config folders (S11). ``files``: path, content; ``module_dirs``: module_id, directory."""
    roots = module_dirs.select("module_id").distinct().withColumn("at", F.lit("."))
    at = roots.unionByName(module_dirs.select("module_id", F.rtrim("directory", F.lit("/")).alias("at"))).distinct()
    name, up = leaf("path"), parent("path")
    exact = files.where(name.isin(DEPLOYMENT_FILES)).withColumn("at", up).withColumn("body", F.when(name == "package.json", package_json()).otherwise(F.substring("content", 1, 8000))).where("body <> ''")
    yaml = files.where(name.rlike(r"\.ya?ml$") & leaf(up).isin(DEPLOYMENT_DIRS)).withColumn("at", parent(up)).withColumn("body", F.substring("content", 1, 5000))
    rows = exact.withColumn("kind", F.lit(0)).unionByName(yaml.withColumn("kind", F.lit(1))).join(at, "at")
    first = Window.partitionBy("module_id", "path").orderBy("kind")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("module_id", "path", F.col("body").alias("content"))
