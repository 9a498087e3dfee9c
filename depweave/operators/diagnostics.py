"""Reports on how well an index resolves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.symbols import is_local
from depweave.operators.resolution import definitions, references


def _listed(symbols: DataFrame) -> DataFrame:
    """index_id, symbol, path of symbols in the documents' symbol lists (the last document wins)."""
    rows = symbols.where((F.col("symbol") != "") & ~is_local())
    return rows.groupBy("index_id", "symbol").agg(F.max_by("relative_path", F.struct("doc_ord", "sym_ord")).alias("path"))


def definition_sources(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """index_id, both, only_occurrences, only_symbols: where definitions come from."""
    a = definitions(occ).select("index_id", "symbol", F.lit(True).alias("a"))
    b = _listed(symbols).select("index_id", "symbol", F.lit(True).alias("b"))
    rows = a.join(b, ["index_id", "symbol"], "full_outer")
    a_, b_ = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return rows.groupBy("index_id").agg(F.count_if(a_ & b_).alias("both"), F.count_if(a_ & ~b_).alias("only_occurrences"), F.count_if(~a_ & b_).alias("only_symbols"))


def occurrence_totals(occ: DataFrame) -> DataFrame:
    """index_id, total, empty, local, non_local."""
    empty = F.coalesce("symbol", F.lit("")) == ""
    return occ.groupBy("index_id").agg(F.count("*").alias("total"), F.count_if(empty).alias("empty"), F.count_if(~empty & is_local()).alias("local"), F.count_if(~empty & ~is_local()).alias("non_local"))


def _known(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """index_id, symbol, own (where occurrences define it), any (the same, else where a symbol list has it)."""
    both = definitions(occ).withColumnRenamed("path", "own").join(_listed(symbols).withColumnRenamed("path", "listed"), ["index_id", "symbol"], "full_outer")
    return both.select("index_id", "symbol", "own", F.coalesce("own", "listed").alias("any"))


def _resolved(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """definitions (occurrences, combined), path, cnt, def_path (null: unresolved) of every reference, from one pass over
    the occurrences' references and definitions."""
    hit = references(occ).join(_known(occ, symbols), ["index_id", "symbol"], "left")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("definitions"), F.col(c).alias("def_path")) for k, c in (("occurrences", "own"), ("combined", "any"))))).alias("d")
    return hit.select("path", "cnt", kinds).select("d.definitions", "path", "cnt", "d.def_path")


def _pair():
    """The pair of files that a reference joins; null within a file."""
    return F.when(F.col("path") != F.col("def_path"), F.struct(F.least("path", "def_path").alias("src"), F.greatest("path", "def_path").alias("dst")))


def resolution_report(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """definitions, resolved, unresolved, file_pairs under occurrence definitions and combined ones."""
    rows = _resolved(occ, symbols).withColumn("pair", _pair())
    found = F.col("def_path").isNotNull()
    sums = rows.groupBy("definitions").agg(*(F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0)).alias(n) for c, n in ((found, "resolved"), (~found, "unresolved"))), F.countDistinct("pair").alias("file_pairs"))
    both = F.explode(F.array(F.lit("occurrences"), F.lit("combined"))).alias("definitions")  # an index without references has its rows too
    rows = occ.sparkSession.range(1).select(both).join(sums, "definitions", "left")
    return rows.select("definitions", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("resolved", "unresolved", "file_pairs")))


def gained_edges(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst that only the combined definitions give."""
    rows = _resolved(occ, symbols).withColumn("pair", _pair()).where("pair is not null")
    return rows.groupBy("pair").agg(F.bool_or(F.col("definitions") == "occurrences").alias("had")).where("not had").select("pair.src", "pair.dst")


def unresolved(occ: DataFrame) -> DataFrame:
    """index_id, path, symbol, cnt of references without a definition in their index."""
    return references(occ).join(definitions(occ).select("index_id", "symbol"), ["index_id", "symbol"], "left_anti")


def top_unresolved(occ: DataFrame, n: int = 15) -> DataFrame:
    """symbol, cnt of the most referenced unresolved symbols, ties by name."""
    return unresolved(occ).groupBy("symbol").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "symbol").limit(n)


def unresolved_packages(occ: DataFrame) -> DataFrame:
    """package (the first four words of the symbol), cnt."""
    package = F.array_join(F.slice(F.split("symbol", " "), 1, 4), " ")
    return unresolved(occ).groupBy(package.alias("package")).agg(F.sum("cnt").alias("cnt"))


def file_reference_profile(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, cross_file, same_file, local_refs, occurrences, symbols of every file."""
    hit = references(occ).join(definitions(occ).withColumnRenamed("path", "def_path"), ["index_id", "symbol"])
    same = F.col("path") == F.col("def_path")
    refs = hit.groupBy("path").agg(F.sum(F.when(~same, F.col("cnt")).otherwise(0)).alias("cross_file"), F.sum(F.when(same, F.col("cnt")).otherwise(0)).alias("same_file"))
    rows = occ.groupBy(F.col("relative_path").alias("path")).agg(F.count("*").alias("occurrences"), F.count_if(is_local()).alias("local_refs"))
    rows = rows.join(refs, "path", "left").join(symbols.groupBy(F.col("relative_path").alias("path")).agg(F.count("*").alias("symbols")), "path", "left")
    return rows.select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cross_file", "same_file", "local_refs", "occurrences", "symbols")))


def missed_symbols(occ: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: symbols, refs, cross_file refs to symbols that only the symbol lists define."""
    only = _listed(symbols).join(definitions(occ), ["index_id", "symbol"], "left_anti").withColumnRenamed("path", "def_path")
    hit = references(occ).join(only, ["index_id", "symbol"])
    sums = hit.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("refs"), F.coalesce(F.sum(F.when(F.col("path") != F.col("def_path"), F.col("cnt"))), F.lit(0)).alias("cross_file"))
    return only.agg(F.count("*").alias("symbols")).join(F.broadcast(sums))


def file_drilldown(occ: DataFrame, symbols: DataFrame, relationships: DataFrame, path: str, top: int = 20, early: int = 30) -> dict[str, DataFrame]:
    """Of one file: profile, targets (the ``top`` files it refers to), early (occurrences before line ``early``),
    related (symbols with relationships) (A35)."""
    own = occ.where(F.col("relative_path") == path)
    defs = definitions(occ).withColumnRenamed("path", "def_path")
    targets = references(own).join(defs, ["index_id", "symbol"]).where("path <> def_path").groupBy("def_path").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "def_path").limit(top)
    return {
        "profile": file_reference_profile(occ, symbols).where(F.col("path") == path),
        "targets": targets,
        "early": own.where(F.get("range", F.lit(0)) < early).select("symbol", "symbol_roles", "range"),
        "related": relationships.where(F.col("relative_path") == path).select("symbol").distinct(),
    }
