"""The given tables read as a code base, a change log and a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_path(prefix: str = "p") -> F.Column:
    return F.concat(F.col(f"{prefix}_brand"), F.lit("/"), F.col(f"{prefix}_type"), F.lit("/p"), F.col(f"{prefix}_partkey").cast("string"), F.lit(".py"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrences of their order's symbol in their part's file; the first line defines it."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", part_path().alias("relative_path"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # Keys meet first, paths last: they aren't shuffled once more.
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    kinds = F.array(*(F.lit(k) for k in (17, 26, 9, 7, 0)))
    return rows.select(
        F.lit("idx").alias("index_id"),
        F.col("l_orderkey").alias("doc_ord"),
        ((F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_suppkey")) * 1000000 + F.col("l_partkey")).alias("occ_ord"),
        "relative_path",
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.when(F.col("o_custkey") % 2 == 0, "().").otherwise("")).alias("symbol"),
        F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("symbol_roles"),
        F.element_at(kinds, (F.col("o_custkey") % 5 + 1).cast("int")).alias("kind"),
    )


def symbols(spark: SparkSession, sf_dir: str, occ: DataFrame | None = None) -> DataFrame:
    """One symbol an occurrence, of ``occ`` where they are written already."""
    return (occurrences(spark, sf_dir) if occ is None else occ).select("index_id", "doc_ord", F.col("occ_ord").alias("sym_ord"), "relative_path", "symbol", "kind", F.col("symbol").alias("display_name"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, component (brand) of every part."""
    return table(spark, sf_dir, "part").select(part_path().alias("path"), F.col("p_brand").alias("component"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part implements an order's symbol: the one with three times the part's number."""
    return table(spark, sf_dir, "part").select(
        F.lit("idx").alias("index_id"), part_path().alias("relative_path"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.concat(F.lit("o"), (F.col("p_partkey") * 3).cast("string")).alias("target_symbol"), F.lit(True).alias("is_implementation"), F.lit(False).alias("is_reference"), F.lit(False).alias("is_type_definition"), F.lit(False).alias("is_definition"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change records of decisions and modules."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 7 == 0, F.col("event_id") + 100000000).otherwise((F.col("event_id") * F.col("event_id")) % 2003)
    action = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("edit")
    return e.select(
        F.when(F.col("event_id") % 11 == 0, "module").otherwise("decision").alias("entity_type"), key.alias("entity_id"), action.alias("action"),
        F.when(action != "add", F.col("props")).alias("old_value"), F.when(action != "remove", F.col("props")).alias("new_value"),
        F.col("user_id").alias("module_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 4).alias("baseline_id"), F.col("event_id").alias("ord"),
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("module", "shared-library", "supporting-asset")))
    r = table(spark, sf_dir, "region")
    return r.select(
        F.col("r_regionkey").cast("long").alias("module_id"), F.col("r_name").alias("name"), F.element_at(kinds, F.col("r_regionkey") % 3 + 1).alias("classification"),
        F.when(F.col("r_regionkey") == 4, F.lit(None)).otherwise("in-repo").alias("source_origin"),
    )


def module_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("module_id"), F.lower("n_name").alias("directory"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("component_id"), F.col("n_regionkey").cast("long").alias("module_id"), F.col("n_name").alias("name"),
        F.concat(F.lit("serves "), F.lower("n_name")).alias("purpose"), (F.col("n_nationkey") % 10 / 10.0).alias("confidence"),
    )


def component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are source files of their nation, suppliers are tests."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("component_id"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.lit(False).alias("is_test"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("component_id"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"), F.lit("/tests/s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), F.lit(True).alias("is_test"))
    return c.unionByName(s)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions: of the customer's nation, every fourth customer's of its region."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    of_module = F.col("o_custkey") % 4 == 0
    return rows.select(
        F.col("o_orderkey").alias("decision_id"), F.when(of_module, F.col("n_regionkey").cast("long")).alias("module_id"), F.when(~of_module, F.col("c_nationkey").cast("long")).alias("component_id"),
        F.col("o_orderpriority").alias("category"), F.concat(F.lit("Rule  "), (F.col("o_orderkey") % 97).cast("string")).alias("text"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("because "), "o_orderstatus")).alias("detail"),
        F.when(F.col("o_orderstatus") == "F", "human").otherwise("pipeline_generated").alias("source"),
    )


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each region to the next two, with labels for the first."""
    r = modules(spark, sf_dir).select(F.col("module_id").alias("source_id"))
    kinds = F.array(*(F.lit(k) for k in ("depends_on", "uses_data_store", "communicates_via")))
    step = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = r.select("source_id", step.alias("k")).select("source_id", ((F.col("source_id") + F.col("k")) % 5).alias("target_id"), "k")
    return rows.select("source_id", "target_id", F.element_at(kinds, F.col("source_id").cast("int") % 3 + 1).alias("edge_type"), (F.col("k") * 1.5).alias("weight"), F.when(F.col("k") == 1, F.concat(F.lit('{"label": "m'), F.col("source_id").cast("string"), F.lit('"}'))).otherwise("oops").alias("metadata"))


def component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the nations of customers and of the suppliers of their orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("source_id"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("target_id"))
    # Orders meet their customers first, so line items aren't shuffled once more for them.
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "source_id")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "source_id").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.count("*").cast("double").alias("weight"))
    return rows.select("source_id", "target_id", F.when((F.col("source_id") + F.col("target_id")) % 2 == 0, "call").otherwise("import").alias("edge_type"), "weight", F.lit("{}").alias("metadata"))


def map_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    made = (modules, module_directories, components, component_files, module_edges, component_edges, decisions)
    return {f.__name__: f(spark, sf_dir) for f in made}


def version(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    """Decisions at two times: the second has other priorities for every tenth order and lacks every eleventh."""
    d = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    named = lambda p, by: F.concat(F.lit(p), (F.col("o_custkey") % by).cast("string"))
    if which == 1:
        old = d.where("o_orderdate < timestamp'1999-01-01'")
        return old.select(key.alias("decision_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("text"), named("c", 9).alias("component_name"), named("m", 3).alias("module_name"), F.lit("human").alias("source"))
    new = d.where("o_orderkey % 11 <> 0")
    category = F.when(key % 10 == 0, F.concat(F.lit("new "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return new.select(key.alias("decision_id"), category.alias("category"), F.col("o_orderstatus").alias("text"), named("c", 8).alias("component_name"), named("m", 3).alias("module_name"), F.when(key % 4 == 0, "chat").otherwise("human").alias("source"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as validation runs; those with an even number are complete."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").cast("string").alias("created_at")).withColumn("status", F.when(F.col("run_id") % 2 == 0, "completed").otherwise("running"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of validation runs."""
    kinds = F.array(*(F.lit(k) for k in ("confirmed", "updated", "outdated", "new", "implemented", "diverged", "unchanged")))
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("run_id"), (F.col("event_id") * 7 % 5000).alias("decision_id"), F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("status"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("new_text"))


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a source tree, of many kinds."""
    names = ["app.py", "Main.java", "lib.rs", "x.TS", "y.ts", "util.h", "mod.go", "README", "notes.txt", "package.json", "web.csproj", "a.min.js", ".env", "test_app.py", "conftest.py", "data.xyz", "q.XYZ", "logo.png"]
    dirs = ["src", "src/core", "node_modules/lib", "tests", "build/out", "spec/unit", "", "docs/api", "pkg/vendor"]
    pick = lambda xs, by: F.element_at(F.array(*(F.lit(x) for x in xs)), (by % len(xs) + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    d = pick(dirs, F.floor(F.col("o_orderkey") / 18))
    name = pick(names, F.col("o_orderkey"))
    name = F.when(F.col("o_orderkey") % 4 == 0, name).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("_"), name))
    return o.select(F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name)).alias("path")).distinct()


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as answers of a model, in several dresses."""
    e = table(spark, sf_dir, "events")
    fence, k = F.lit("```"), F.col("event_id") % 8
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("  "), "props", F.lit("\n"))).when(k == 2, F.concat(F.lit("Here:\n"), fence, F.lit("json\n"), "props", F.lit("\n"), fence, F.lit("\nDone")))
    text = text.when(k == 3, F.concat(fence, F.lit("\n"), "props", F.lit("\n"), fence)).when(k == 4, F.concat(F.lit("I think "), "props", F.lit(" is right."))).when(k == 5, F.lit("no answer")).when(k == 6, F.concat(F.lit("["), "props", F.lit("]")))
    return e.select(F.col("event_id").alias("request_id"), text.alias("text"))
