"""From occurrences and symbols to counted dependencies between files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.symbols import is_callable, is_definition, is_local
from depweave.operators.spread import spread_join
from depweave.sources.scratch import cut

_ORDER = ["doc_ord", "occ_ord"]


def definitions(occ: DataFrame) -> DataFrame:
    """index_id, symbol, path: where each non-local, non-empty symbol is defined; the last occurrence in
    (doc_ord, occ_ord) wins (A1)."""
    rows = occ.where((F.col("symbol") != "") & ~is_local() & is_definition())
    return rows.groupBy("index_id", "symbol").agg(F.max_by("relative_path", F.struct(*_ORDER)).alias("path"))


def symbol_kinds(symbols: DataFrame) -> DataFrame:
    """index_id, symbol, kind: the last kind that isn't 0 (A2)."""
    return symbols.where("kind <> 0").groupBy("index_id", "symbol").agg(F.max_by("kind", F.struct("doc_ord", "sym_ord")).alias("kind"))


def references(occ: DataFrame) -> DataFrame:
    """index_id, path, symbol, cnt: references to non-local symbols, counted per file **before** any join.

    A symbol that is referenced everywhere is then one row a file, which keeps hot symbols small."""
    rows = occ.where((F.col("symbol") != "") & ~is_local() & ~is_definition())
    return rows.groupBy("index_id", F.col("relative_path").alias("path"), "symbol").agg(F.count("*").alias("cnt"))


def resolve_references(occ: DataFrame, files: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """index_id, path, symbol, def_path, cnt, callable: references to symbols defined in another file of the
    same index, both files in ``files`` (a ``path`` table; None: all files) (J2).

    References are counted per file before the join; those to a symbol that very many files use are dealt over tasks."""
    defs = definitions(occ).withColumnRenamed("path", "def_path")
    refs = references(occ)
    if files is not None:
        own = files.select("path").distinct()
        refs = refs.join(own, "path", "left_semi")
        defs = defs.join(own.withColumnRenamed("path", "def_path"), "def_path", "left_semi")
    # What is known of a symbol meets its definition first, one row each.
    defs = defs.withColumn("kind", F.lit(0)) if kinds is None else defs.join(kinds, ["index_id", "symbol"], "left")
    out = spread_join(cut(refs, "references"), defs, ["index_id", "symbol"]).where("path <> def_path")
    return out.select("index_id", "path", "symbol", "def_path", "cnt", is_callable().alias("callable"))


def resolve_inheritance(relationships: DataFrame, occ: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """index_id, path, def_path, cnt: implementation relationships to symbols of another file."""
    defs = definitions(occ).select("index_id", F.col("symbol").alias("target_symbol"), F.col("path").alias("def_path"))
    rows = relationships.where("is_implementation").groupBy("index_id", F.col("relative_path").alias("path"), "target_symbol").agg(F.count("*").alias("cnt"))
    out = spread_join(cut(rows, "inherited"), defs, ["index_id", "target_symbol"]).where("path <> def_path")
    if files is not None:
        own = files.select("path").distinct()
        out = out.join(own, "path", "left_semi").join(own.withColumnRenamed("path", "def_path"), "def_path", "left_semi")
    return out.select("index_id", "path", "def_path", "cnt")


def file_edges(occ: DataFrame, symbols: DataFrame, relationships: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """index_id, src, dst, edge_type, cnt with src < dst (A3).

    Every resolved cross-file reference counts as ``import``, those to callables as ``call`` too, and
    implementation relationships as ``inheritance``."""
    refs = resolve_references(occ, files, symbol_kinds(symbols))
    both = ["index_id", F.least("path", "def_path").alias("src"), F.greatest("path", "def_path").alias("dst")]
    counts = refs.groupBy(*both).agg(F.sum("cnt").alias("import"), F.sum(F.when(F.col("callable"), F.col("cnt")).otherwise(0)).alias("call"))
    kinds = F.array(*(F.struct(F.lit(k).alias("edge_type"), F.col(k).alias("cnt")) for k in ("import", "call")))
    out = counts.select("index_id", "src", "dst", F.explode(kinds).alias("e")).select("index_id", "src", "dst", "e.edge_type", "e.cnt").where("cnt > 0")
    if relationships is not None:
        inherited = resolve_inheritance(relationships, occ, files).groupBy(*both).agg(F.sum("cnt").alias("cnt"))
        out = out.unionByName(inherited.select("index_id", "src", "dst", F.lit("inheritance").alias("edge_type"), "cnt"))
    return out


def index_stats(occ: DataFrame, files: DataFrame) -> DataFrame:
    """n_definitions (symbols defined in ``files``) and n_files of each index (A4)."""
    defs = definitions(occ).join(files.select("path").distinct(), "path", "left_semi").groupBy("index_id").agg(F.count("*").alias("n_definitions"))
    seen = occ.select("index_id", F.col("relative_path").alias("path")).distinct().join(files.select("path").distinct(), "path", "left_semi")
    return seen.groupBy("index_id").agg(F.count("*").alias("n_files")).join(defs, "index_id", "left").select("index_id", F.coalesce("n_definitions", F.lit(0)).alias("n_definitions"), "n_files")


def merge_indexes(edges: list[DataFrame]) -> DataFrame:
    """One edge table of several per-language ones: counts of a pair and type add up."""
    out = edges[0]
    for x in edges[1:]:
        out = out.unionByName(x)
    return out.groupBy("src", "dst", "edge_type").agg(F.sum("cnt").alias("cnt"))


def merge_index_results(parts: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, files, stats) of several indexes' (edges, files, stats) (S5): counts of edges add up, files (path) are
    joined, definitions too add up. ``stats``: index_id, n_definitions, n_files; an index without files drops out."""
    every = [x for x in zip(*parts, strict=True)]
    files, stats = every[1][0].select("path"), every[2][0]
    for f, s in zip(every[1][1:], every[2][1:], strict=True):
        files, stats = files.unionByName(f.select("path")), stats.unionByName(s)
    files = files.distinct()
    one = stats.where("n_files > 0").agg(F.coalesce(F.sum("n_definitions"), F.lit(0)).alias("n_definitions"), F.count("*").alias("n_indexes"))
    return merge_indexes(list(every[0])), files, one.join(F.broadcast(files.agg(F.count("*").alias("n_files"))))
