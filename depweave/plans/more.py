"""More queries over the given tables: requests, responses, edits, sources, and what else stands by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions import paths, symbols
from depweave.operators import changes, checks, cluster, components, diagnostics, documents, maptables, rollup, textbatch, versions, weights
from depweave.plans import views as V
from depweave.plans.registry import _NET_SQL, _assign, _calls, _code, _nodes, register
from depweave.plans.sql import DIR, TEST, query
from depweave.sources import languages, readers, scratch


def text(*parts) -> F.Column:
    """Texts and columns one after the other."""
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def key_of(name: str) -> F.Column:
    return F.col(name).cast("long")


# Sources.


@register(query("SELECT 'a' || (l_partkey % 50) AS relative_path, 'o' || l_orderkey AS symbol, CAST(l_linenumber % 2 AS INTEGER) AS symbol_roles, l_suppkey AS line, count(*) AS n FROM lineitem GROUP BY ALL"))
def flatten_index(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as occurrences in the documents of one nested index record a supplier."""
    rows = V.table(spark, sf, "lineitem").select(
        text("i", F.col("l_suppkey")).alias("index_id"), text("a", F.col("l_partkey") % 50).alias("relative_path"),
        F.struct(text("o", F.col("l_orderkey")).alias("symbol"), (F.col("l_linenumber") % 2).cast("int").alias("symbol_roles"), F.array(F.col("l_suppkey").cast("int")).alias("range")).alias("o"),
    )
    none = F.array().cast("array<struct<symbol string, kind int, display_name string, relationships array<struct<symbol string, is_implementation boolean, is_reference boolean, is_type_definition boolean, is_definition boolean>>>>")
    docs = rows.groupBy("index_id", "relative_path").agg(F.collect_list("o").alias("occurrences"))
    docs = docs.select("index_id", F.struct("relative_path", F.lit("py").alias("language"), F.lit("").alias("text"), "occurrences", none.alias("symbols")).alias("d"))
    nested = docs.groupBy("index_id").agg(F.collect_list("d").alias("documents")).withColumns({c: F.lit("") for c in ("project_root", "tool_name", "tool_version")})
    flat = readers.flatten_index(nested).occurrences
    return flat.groupBy("relative_path", "symbol", "symbol_roles", F.col("range")[0].cast("long").alias("line")).agg(F.count("*").alias("n"))


_SIZES = "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 7 = 1 THEN 0 ELSE length(html) END AS size FROM pages"


@register(query("SELECT page_id, CASE WHEN size IS NULL THEN 'missing' WHEN size = 0 THEN 'empty' WHEN size > 2000 THEN 'too large' ELSE 'admitted' END AS reason FROM s", s=_SIZES))
def admit_files(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("page_id") % 7 != 0, F.when(F.col("page_id") % 7 == 1, 0).otherwise(F.length("html")))
    ok, bad = readers.admit_files(V.table(spark, sf, "pages").select("page_id", size.alias("length")), 2000)
    return ok.select("page_id", F.lit("admitted").alias("reason")).unionByName(bad.select("page_id", "reason"))


@register(query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE 'good' END AS state, CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) END AS k FROM events"))
def split_records(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as JSON lines, every fifth of them cut off."""
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 5 == 0, "").otherwise("}"))
    schema = readers.T.StructType.fromDDL("id long, k long")
    good, bad, _ = readers.split_records(V.table(spark, sf, "events").select(line.alias("value")), schema)
    lost = bad.select(F.regexp_extract("value", '"id": ([0-9]+)', 1).cast("long").alias("event_id"), F.lit("bad").alias("state"), F.lit(None).cast("long").alias("k"))
    return good.select(F.col("id").alias("event_id"), F.lit("good").alias("state"), "k").unionByName(lost)


@register(query("SELECT 'C' || c_custkey AS module, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS component, o_orderkey AS decision, CASE WHEN o_orderkey % 3 = 0 THEN 'chat' ELSE 'pipeline_generated' END AS source FROM orders JOIN customer ON o_custkey = c_custkey"))
def read_map_json(spark: SparkSession, sf: str) -> DataFrame:
    """A published map a customer, with two components of its orders as decisions; imported into one."""
    o, c = F.col("o_orderkey"), V.table(spark, sf, "customer").select("c_custkey")
    d = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (o % 2).alias("odd"), F.struct(o.alias("id"), F.lit("patterns").alias("category"), o.cast("string").alias("text"), F.when(o % 3 == 0, "chat").alias("source")).alias("d"))
    n = d.groupBy("c_custkey", "odd").agg(F.collect_list("d").alias("decisions"))
    n = n.select("c_custkey", F.struct((F.col("c_custkey") * 2 + F.col("odd")).alias("id"), F.when(F.col("odd") == 0, "even").otherwise("odd").alias("name"), "decisions").alias("c")).groupBy("c_custkey").agg(F.collect_list("c").alias("components"))
    m = c.join(n, "c_custkey").select("c_custkey", F.struct(F.array(F.struct(F.col("c_custkey").alias("id"), text("C", F.col("c_custkey")).alias("name"), "components")).alias("modules")).alias("m"))
    line = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.lit(1).alias("version"), F.col("m").alias("map")))).otherwise(F.to_json("m"))
    maps, _ = readers.read_map_json(m.select(line.alias("value")))
    t = maptables.import_map(maps)
    rows = t["decisions"].join(t["components"].select("component_id", F.col("module_id").alias("m"), F.col("name").alias("component")), "component_id")
    return rows.join(t["modules"].select(F.col("module_id").alias("m"), F.col("name").alias("module")), "m").select("module", "component", F.col("text").cast("long").alias("decision"), "source")


@register(query("SELECT regexp_replace(path, 'app[.]py$', 'Dockerfile') AS path, 'FROM x' AS content FROM rfiles WHERE path IN ('app.py', 'src/app.py', 'docs/api/app.py')", "rfiles"))
def select_deployment_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files named app.py as Dockerfiles: those at the root and in two directories count."""
    files = V.repo_files(spark, sf).select(F.regexp_replace("path", r"app\.py$", "Dockerfile").alias("path"), F.lit("FROM x").alias("content"))
    dirs = V.table(spark, sf, "region").where("r_regionkey < 2").select(F.lit(1).alias("module_id"), F.when(F.col("r_regionkey") == 0, "src/").otherwise("docs/api").alias("directory"))
    return readers.select_deployment_files(files, dirs).select("path", "content")


# Paths, symbols and rows.


@register(query("SELECT CAST(path AS VARCHAR) AS path FROM rfiles WHERE NOT starts_with(regexp_extract(path, '[^/]*$'), '.') AND regexp_matches(regexp_extract(path, '[^/]*$'), '.\\.[^.]+$') AND lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.(\\.[^.]+)$', 1)) NOT IN ('.png', '.json', '.env')", "rfiles"))
def filter_source_like(spark: SparkSession, sf: str) -> DataFrame:
    return paths.filter_source_like(V.repo_files(spark, sf))


@register(query("SELECT 'repo/' AS strip, 'core/x/' AS add"))
def detect_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """What must go from, and be put before, the paths of all repository files to fall into a module."""
    files = V.repo_files(spark, sf)
    dirs = spark.createDataFrame([(0, "nowhere"), (1, "src")], "dir_ord int, directory string")
    strip = paths.detect_strip_prefix(files.select(F.concat(F.lit("repo/"), "path").alias("relative_path"), F.xxhash64("path").alias("doc_ord")), dirs).withColumnRenamed("prefix", "strip")
    inner = spark.createDataFrame([(0, "core")], "dir_ord int, directory string")
    add = paths.detect_add_prefix(files.select(F.col("path").alias("relative_path"), F.col("path").alias("doc_ord")), inner, "file:///home/o'neil/core/x").withColumnRenamed("prefix", "add")
    return strip.join(F.broadcast(add))


@register(query("SELECT CASE WHEN starts_with(path, 'src') THEN '../' || path ELSE 'p/' || path END AS path FROM rfiles", "rfiles"))
def prepend_prefix(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.repo_files(spark, sf).select(F.when(F.startswith("path", F.lit("src")), F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"))
    return paths.prepend_prefix(rows, "p/", "path")


@register(query("SELECT symbol, path, CASE kind WHEN 17 THEN 'Function' WHEN 26 THEN 'Method' WHEN 9 THEN 'Constructor' WHEN 7 THEN 'Class' END AS name, count(*) AS n FROM occ GROUP BY ALL", "occ"))
def kind_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.symbols(spark, sf).select("symbol", F.col("relative_path").alias("path"), symbols.kind_name().alias("name"))
    return rows.groupBy("symbol", "path", "name").agg(F.count("*").alias("n"))


@register(query("SELECT c_custkey AS module_id, CASE WHEN f = '' THEN 'Module_' || c_custkey WHEN rn > 1 THEN f || '_' || c_custkey ELSE f END AS file_name FROM (SELECT c_custkey, f, row_number() OVER (PARTITION BY CASE WHEN f = '' THEN 'Module_' || c_custkey ELSE f END ORDER BY c_custkey) AS rn FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A_' || (c_custkey % 9) WHEN 2 THEN 'A-' || (c_custkey % 7) ELSE 'x_y_z' END AS f FROM customer))"))
def doc_filenames(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "!?").when(k % 4 == 1, text(" A & ", k % 9, "!")).when(k % 4 == 2, text("A-", k % 7)).otherwise("x_y  z")
    return textbatch.with_doc_filename(V.table(spark, sf, "customer").select(k.alias("module_id"), name.alias("name"))).select("module_id", "file_name")


@register(query("SELECT decision_id, category FROM decs WHERE component_id IS NULL AND source = 'human'", "decs"))
def select_rows(spark: SparkSession, sf: str) -> DataFrame:
    return maptables.select_rows(V.decisions(spark, sf), component_id=None, source="human").select("decision_id", "category")


@register(query("SELECT decision_id, trim(text) AS text, nullif(trim(detail), '') AS detail FROM d WHERE category IN ('1-URGENT', '2-HIGH') AND trim(text) <> ''", "decs", d="SELECT decision_id, category, CASE WHEN decision_id % 7 = 0 THEN '  ' ELSE ' ' || text END AS text, CASE WHEN decision_id % 3 = 0 THEN ' ' ELSE detail END AS detail FROM decs"))
def validate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = V.decisions(spark, sf)
    d = d.withColumn("text", F.when(F.col("decision_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "text"))).withColumn("detail", F.when(F.col("decision_id") % 3 == 0, " ").otherwise(F.col("detail")))
    return textbatch.validate_decisions(d, ["1-URGENT", "2-HIGH"]).select("decision_id", "text", "detail")


@register(query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 IN (1, 2, 3, 4)"))
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 9, F.col("c_custkey") % 10 / 10.0).alias("confidence"))
    return components.low_confidence(rows).select("id")


@register(query("SELECT path, language FROM (SELECT path, CASE regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' END AS language FROM rfiles) WHERE language IS NOT NULL", "rfiles"))
def filter_languages(spark: SparkSession, sf: str) -> DataFrame:
    return languages.filter_languages(languages.classified(V.repo_files(spark, sf), []), ["PY ", "typescript", "none"]).select("path", "language")


@register(query("SELECT CAST(rn AS INTEGER) AS rank, '.' || ext AS label, n FROM r WHERE rn <= 2 UNION ALL SELECT 3, '... and ' || count(*) || ' more extensions (' || sum(n) || ' files)', CAST(sum(n) AS BIGINT) FROM r WHERE rn > 2 HAVING count(*) > 0", "rfiles",
                f="SELECT lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1)) AS ext, regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1) AS raw FROM rfiles",
                r="SELECT ext, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ext) AS rn FROM f WHERE ext <> '' AND raw NOT IN ('py', 'java', 'rs', 'ts', 'h', 'go', 'js') GROUP BY ext"))
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return languages.coverage_summary(languages.unrecognised(V.repo_files(spark, sf), []), 2)


@register(query("SELECT count(*) FILTER (NOT x) AS total, count(*) FILTER (NOT x AND ext IN ('py', 'java', 'rs', 'ts', 'h', 'go', 'js')) AS supported, count(*) FILTER (x) AS excluded, round(100.0 * count(*) FILTER (NOT x AND ext IN ('py', 'java', 'rs', 'ts', 'h', 'go', 'js')) / count(*) FILTER (NOT x), 6) AS coverage FROM f", "rfiles",
                f="SELECT regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1) AS ext, list_contains(string_split(path, '/'), 'node_modules') OR list_contains(string_split(path, '/'), 'build') OR list_contains(string_split(path, '/'), '.env') OR path LIKE '%.min.js' AS x FROM rfiles"))
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return languages.coverage(V.repo_files(spark, sf)).withColumn("coverage", F.round(F.col("coverage").cast("double"), 6))


# Components and graphs.


@register(query("SELECT split_part(node, '/', 1) AS partition, count(*) AS n, CAST(greatest(2, 20 * count(*) // (SELECT count(*) FROM nodes)) AS INTEGER) AS target FROM nodes GROUP BY 1", "nodes"))
def partition_targets(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.partition_targets(_nodes(spark, sf).select("node", F.split_part("node", F.lit("/"), F.lit(1)).alias("partition")), 20)


_PROFILE = f"SELECT cluster, {DIR.format('node')} AS dir, count(*) AS n FROM a GROUP BY ALL"
_BRAND = "SELECT node, CAST(regexp_extract(node, '#([0-9]+)/', 1) AS INTEGER) AS cluster FROM nodes"


@register(query("SELECT cluster, dir AS a, '' AS b, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, dir) AS rn FROM d) WHERE rn <= 10 UNION ALL SELECT cluster, src, dst, cnt FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, src, dst) AS rn FROM e) WHERE rn <= 10", "nodes", "fedges",
                a=_BRAND, d=_PROFILE, e="SELECT x.cluster, src, dst, cnt FROM fedges JOIN a x ON x.node = src JOIN a y ON y.node = dst WHERE edge_type = 'call' AND x.cluster = y.cluster"))
def cluster_profile(spark: SparkSession, sf: str) -> DataFrame:
    occ = _code(spark, sf)
    dirs, inner = components.cluster_profile(_assign(spark, sf, occ), scratch.cut(_calls(spark, sf, occ), "calls"))
    return dirs.select("cluster", F.col("dir").alias("a"), F.lit("").alias("b"), "n").unionByName(inner.select("cluster", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("cnt").alias("n")))


@register(query("SELECT node, degree FROM deg WHERE degree % 2 = 1", "deg"))
def strip_virtual(spark: SparkSession, sf: str) -> DataFrame:
    """Files of even degree as virtual nodes."""
    from depweave.plans.registry import _weighted

    deg = weights.degrees(_weighted(spark, sf))
    return weights.strip_virtual(deg, deg.select("node", (F.col("degree") % 2 == 0).alias("is_virtual")))


_CE = "SELECT source_id AS source, target_id AS target, edge_type, weight FROM cedges"


def _component_edges(spark, sf):
    return V.component_edges(spark, sf).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "edge_type", "weight")


@register(query("SELECT 'node' AS kind, component_id AS a, CAST(NULL AS BIGINT) AS b FROM hit UNION ALL SELECT 'edge', source, target FROM ce WHERE source IN (SELECT component_id FROM hit) OR target IN (SELECT component_id FROM hit)", "cedges", "comps", ce=_CE, hit="SELECT component_id FROM comps WHERE contains(lower(name), 'ion_1')"))
def search_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes = V.components(spark, sf).select(F.col("component_id").alias("node"), F.col("name").alias("label"))
    hits, touched = rollup.search_graph(nodes, _component_edges(spark, sf), " Ion_1 ")
    return hits.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(touched.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@register(query("SELECT * FROM ce WHERE source = 3 OR target = 3", "cedges", ce=_CE))
def incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.incident_edges(_component_edges(spark, sf), 3)


@register(query("SELECT node, count(*) AS degree, count(DISTINCT least(node, o) || '-' || greatest(node, o)) AS pairs FROM (SELECT source AS node, target AS o FROM ce UNION ALL SELECT target, source FROM ce) GROUP BY 1", "cedges", ce=_CE))
def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    e = _component_edges(spark, sf)
    return rollup.node_degrees(e).join(rollup.node_degrees(e, distinct_pairs=True).withColumnRenamed("degree", "pairs"), "node")


@register(query("SELECT string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types, 0.0::DOUBLE AS min_weight, ceil(max(weight)) AS max_weight FROM ce", "cedges", ce=_CE))
def edge_facets(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.edge_facets(_component_edges(spark, sf)).withColumn("edge_types", F.array_join("edge_types", ","))


@register(query("SELECT source, target, edge_type, coalesce((SELECT label FROM lab WHERE lab.s = source AND lab.t = target ORDER BY ord DESC LIMIT 1), '') AS label FROM ce", "cedges", ce=_CE,
                lab="SELECT c_custkey % 25 AS s, c_custkey % 24 AS t, c_custkey AS ord, 'l' || c_custkey AS label FROM customer WHERE c_custkey % 4 <> 0"))
def apply_edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    labels = V.table(spark, sf, "customer").select((k % 25).alias("source"), (k % 24).alias("target"), k.alias("ord"), F.when(k % 4 == 0, " ").otherwise(text("l", k)).alias("label"), F.explode(F.array(F.lit("call"), F.lit("import"))).alias("edge_type"))
    return rollup.apply_edge_labels(_component_edges(spark, sf), labels).select("source", "target", "edge_type", "label")


@register(query("SELECT source, target, edge_type, weight FROM old WHERE source NOT IN (SELECT component FROM f) AND target NOT IN (SELECT component FROM f) UNION ALL SELECT source, target, edge_type, round(raw * 10 / max(raw) OVER (PARTITION BY m), 1) FROM r", "fedges", "pfiles",
                f="SELECT component, path, length(component) AS m FROM pfiles WHERE component <> 'Brand#11'",
                old="SELECT 'Brand#11' AS source, 'Brand#' || s_suppkey AS target, 'call' AS edge_type, 1.0::DOUBLE AS weight FROM supplier",
                p="SELECT least(a.component, b.component) AS source, greatest(a.component, b.component) AS target, a.m, edge_type, sum(cnt) AS cnt FROM fedges JOIN f a ON a.path = src JOIN f b ON b.path = dst WHERE a.component <> b.component AND a.m = b.m GROUP BY ALL",
                n="SELECT component, count(*) AS n FROM f GROUP BY 1",
                r="SELECT source, target, p.m, edge_type, cnt / sqrt(CAST(a.n * b.n AS DOUBLE)) AS raw FROM p JOIN n a ON a.component = source JOIN n b ON b.component = target"))
def refresh_edges(spark: SparkSession, sf: str) -> DataFrame:
    from depweave.plans.registry import _edges

    files = V.part_files(spark, sf).where("component <> 'Brand#11'").withColumn("module_id", F.length("component"))
    old = V.table(spark, sf, "supplier").select(F.lit("Brand#11").alias("source"), text("Brand#", F.col("s_suppkey")).alias("target"), F.lit("call").alias("edge_type"), F.lit(1.0).alias("weight"))
    return rollup.refresh_edges(_edges(spark, sf), files, old)


@register(query("SELECT name, confidence, purpose, files FROM (SELECT trim(n) AS name, max(c) AS confidence, string_agg(CASE WHEN rn = 1 THEN p END, '; ' ORDER BY o) AS purpose FROM (SELECT *, row_number() OVER (PARTITION BY trim(n), p ORDER BY o) AS rn FROM c) GROUP BY 1) JOIN (SELECT k, count(DISTINCT path) AS files FROM f GROUP BY 1) ON k = name",
                c="SELECT c_custkey AS o, 'N' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END AS n, (c_custkey % 10) / 10.0::DOUBLE AS c, '<' || (c_custkey % 3) || '>' AS p FROM customer",
                f="SELECT 'N' || c_nationkey AS k, c_custkey % 40 AS path FROM customer"))
def merge_same_name(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = V.table(spark, sf, "customer").select(k.alias("ord"), text("N", F.col("c_nationkey"), F.when(k % 2 == 0, " ").otherwise("")).alias("name"), (k % 10 / 10.0).alias("confidence"), text("<", k % 3, ">").alias("purpose"), (k % 40).alias("path"))
    merged, files = components.merge_same_name(c, c.select("name", "path"))
    return merged.select("name", "confidence", "purpose").join(files.groupBy("name").agg(F.count("*").alias("files")), "name")


_SPLITS = "SELECT c_nationkey AS cluster, c_custkey % 3 AS part_ord, 'part' || (c_custkey % 3) AS name, 'f' || c_custkey AS path FROM customer WHERE c_custkey % 4 <> 0"


@register(query("SELECT c_nationkey AS cluster, 'f' || c_custkey AS path, coalesce(s.name, first.name) AS name FROM customer LEFT JOIN s ON s.path = 'f' || c_custkey LEFT JOIN first ON first.cluster = c_nationkey WHERE coalesce(s.name, first.name) IS NOT NULL", s=_SPLITS, first="SELECT cluster, arg_min(name, part_ord) AS name FROM s GROUP BY 1"))
def apply_split_responses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster"), text("f", k).alias("path"), (k % 3).alias("part_ord"), text("part", k % 3).alias("name"), k.alias("k"))
    return components.apply_split_responses(c.select("cluster", "path"), c.where("k % 4 <> 0").select("cluster", "part_ord", "name", "path"))


@register(query("""SELECT c_custkey AS cluster, CASE WHEN k = 2 THEN 'p' || p WHEN k = 1 THEN 'p0' ELSE c_name END AS name, CAST(CASE WHEN k = 0 THEN 0.3 WHEN k = 3 THEN coalesce(conf, 0.5) ELSE coalesce(conf, 0.7) END AS DOUBLE) AS confidence FROM (
                SELECT c_custkey, c_name, c_custkey % 4 AS k, CASE WHEN c_custkey % 3 = 0 THEN 0.9 END AS conf FROM customer) JOIN (SELECT unnest([0, 1]) AS p) ON k = 2 OR p = 0"""))  # fmt: skip
def components_from_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as clusters: without an answer, with one name for two parts, split in two, and without parts."""
    n = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("cluster"), F.col("c_name").alias("name"))
    k = F.col("cluster") % 4
    parts = F.when(k.isin(1, 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(None).cast("int")))
    r = n.where("cluster % 4 > 0").select("cluster", F.lit(True).alias("ok"), (k == 2).alias("should_split"), F.when(F.col("cluster") % 3 == 0, 0.9).alias("confidence"), F.lit("main").alias("primary_responsibility"), F.explode(parts).alias("part_ord"))
    r = r.select("*", text("p", F.col("part_ord")).alias("name"), F.lit(None).cast("string").alias("purpose"))
    return components.components_from_responses(n, r).select("cluster", "name", "confidence")


@register(query("""SELECT t.path, coalesce((SELECT component FROM s WHERE s.dir = t.dir OR starts_with(t.dir, s.dir || '/') ORDER BY s.path LIMIT 1), CASE WHEN t.dir = 'q/nation1' THEN 'NATION_1' END) AS component FROM t WHERE coalesce((SELECT component FROM s WHERE s.dir = t.dir OR starts_with(t.dir, s.dir || '/') ORDER BY s.path LIMIT 1), CASE WHEN t.dir = 'q/nation1' THEN 'NATION_1' END) IS NOT NULL""",
                s="SELECT 'd' || (c_custkey % 20) || '/s' || c_custkey || '.py' AS path, 'd' || (c_custkey % 20) AS dir, 'N' || c_nationkey AS component FROM customer WHERE c_custkey % 20 < 15",
                t="SELECT dir || '/test_' || s_suppkey || '.py' AS path, dir FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'q/nation1' ELSE 'd' || (s_suppkey % 20) || '/sub' END AS dir FROM supplier)"))
def assign_new_tests(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    sources = V.table(spark, sf, "customer").where("c_custkey % 20 < 15").select(text("d", k % 20, "/s", k, ".py").alias("path"), text("N", F.col("c_nationkey")).alias("component"))
    tests = V.table(spark, sf, "supplier").select(text(F.when(s % 5 == 0, "q/nation1").otherwise(text("d", s % 20, "/sub")), "/test_", s, ".py").alias("path"))
    return components.assign_new_tests(tests, sources, V.components(spark, sf).select(F.col("name").alias("component")))


# Versions and changes.


@register(query("SELECT e.event_id, e.status, CASE WHEN e.status = 'updated' THEN d.text END AS old_text, d.module_id, d.component_id FROM e LEFT JOIN decs d ON d.decision_id = e.decision_id", "outc", "decs", e="SELECT ord AS event_id, decision_id, status FROM outc"))
def join_validations(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.outcomes(spark, sf).select(F.col("ord").alias("event_id"), "decision_id", "status")
    return versions.join_validations(rows, V.decisions(spark, sf)).select("event_id", "status", "old_text", "module_id", "component_id")


@register(query("SELECT decision_id, a.action, o.status FROM decs d LEFT JOIN a ON a.entity_id = d.decision_id LEFT JOIN o USING (decision_id)", "decs", "ch", "outc",
                a="SELECT entity_id, arg_max(action, ord) AS action FROM ch WHERE entity_type = 'decision' GROUP BY 1", o="SELECT decision_id, arg_max(status, ord) AS status FROM outc GROUP BY 1"))
def decision_badges(spark: SparkSession, sf: str) -> DataFrame:
    o = V.outcomes(spark, sf).withColumns({"old_text": F.lit(None).cast("string"), "reason": F.lit("")})
    return versions.decision_badges(V.decisions(spark, sf), V.changes(spark, sf), o).select("decision_id", "action", "status")


@register(query("SELECT run_id, affected, paths FROM (SELECT run_id, (SELECT string_agg(DISTINCT CAST(d.module_id AS VARCHAR), ',' ORDER BY CAST(d.module_id AS VARCHAR)) FROM outc o JOIN decs d USING (decision_id) WHERE o.run_id = r.run_id AND o.status NOT IN ('confirmed', 'unchanged') AND d.module_id <> 0) AS affected, 'p' || run_id AS paths FROM vruns r WHERE status = 'completed' ORDER BY created_at DESC, run_id DESC LIMIT 1)", "outc", "decs", "vruns"))
def validation_overview(spark: SparkSession, sf: str) -> DataFrame:
    runs = V.runs(spark, sf).withColumn("summary", text('{"new_file_paths": ["p', F.col("run_id"), '"]}'))
    rows = versions.validation_overview(runs, V.outcomes(spark, sf), V.decisions(spark, sf))
    return rows.select("run_id", F.nullif(F.array_join(F.array_sort(F.transform("affected_module_ids", lambda x: x.cast("string"))), ","), F.lit("")).alias("affected"), F.array_join("new_file_paths", ",").alias("paths"))


@register(query("SELECT decision_id, module_id, text FROM decs WHERE decision_id NOT IN (SELECT decision_id FROM decs WHERE decision_id % 10 = 3) UNION ALL SELECT (SELECT max(decision_id) FROM decs) + row_number() OVER (ORDER BY n_nationkey), CAST(n_regionkey AS BIGINT), 'all ' || n_name FROM nation", "decs"))
def apply_elevation(spark: SparkSession, sf: str) -> DataFrame:
    d = V.decisions(spark, sf)
    ids = d.where("decision_id % 10 = 3").groupBy((F.col("decision_id") % 25).alias("ord")).agg(F.collect_list("decision_id").alias("source_ids"))
    e = V.table(spark, sf, "nation").select(key_of("n_nationkey").alias("ord"), key_of("n_regionkey").alias("module_id"), F.lit("patterns").alias("category"), text("all ", F.col("n_name")).alias("text"), F.lit(None).cast("string").alias("detail")).join(ids, "ord", "left")
    return versions.apply_elevation(d, e).select("decision_id", "module_id", "text")


@register(query("SELECT decision_id FROM decs WHERE source <> 'pipeline_generated'", "decs"))
def clear_generated(spark: SparkSession, sf: str) -> DataFrame:
    return versions.clear_generated(V.decisions(spark, sf)).select("decision_id")


@register(query("SELECT baseline_id, created_at FROM b UNION ALL SELECT max(baseline_id) + 1, 'now' FROM b", "ch", b="SELECT DISTINCT baseline_id, 'then' AS created_at FROM ch WHERE baseline_id IS NOT NULL"))
def new_baseline(spark: SparkSession, sf: str) -> DataFrame:
    base = V.changes(spark, sf).where("baseline_id is not null").select("baseline_id", F.lit("then").alias("created_at")).distinct()
    return changes.new_baseline(base, "now")


@register(query("SELECT decision_id, CASE WHEN decision_id % 2 = 0 THEN 'new ' || decision_id ELSE text END AS text, CASE WHEN decision_id % 2 = 0 AND decision_id % 3 = 0 THEN 'c' ELSE category END AS category, CASE WHEN decision_id % 2 = 0 THEN 'human' ELSE source END AS source FROM decs", "decs"))
def update_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = V.decisions(spark, sf)
    p = d.where("decision_id % 2 = 0").select("decision_id", text("new ", F.col("decision_id")).alias("text"), F.when(F.col("decision_id") % 3 == 0, "c").alias("category"))
    return changes.update_decisions(d, p).select("decision_id", "text", "category", "source")


@register(query("SELECT path, event_id, 'inserted' AS state FROM f WHERE path IS NULL UNION ALL SELECT path, event_id, CASE WHEN rn = 1 AND path NOT IN (SELECT 'u' || c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN 'inserted' ELSE 'conflict' END FROM f WHERE path IS NOT NULL",
                f="SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN 'u' || user_id END AS path, row_number() OVER (PARTITION BY CASE WHEN event_id % 11 <> 0 THEN 'u' || user_id END ORDER BY event_id) AS rn FROM events"))
def insert_unique(spark: SparkSession, sf: str) -> DataFrame:
    new = V.table(spark, sf, "events").select(F.when(F.col("event_id") % 11 != 0, text("u", F.col("user_id"))).alias("path"), "event_id")
    known = V.table(spark, sf, "customer").where("c_custkey % 3 = 0").select(text("u", F.col("c_custkey")).alias("path"))
    ok, bad = changes.insert_unique(known, new, ["path"], ["event_id"])
    return ok.withColumn("state", F.lit("inserted")).unionByName(bad.withColumn("state", F.lit("conflict")))


_PROPS = "SELECT event_id AS p, CASE WHEN event_id % 6 = 5 THEN 'applied' ELSE 'pending' END AS status, ['add', 'edit', 'remove'][event_id % 3 + 1] AS action, event_id * 7 % 5000 AS d, event_id % 2 = 0 AS sel FROM events"


@register(query("SELECT p AS id, CASE WHEN status <> 'pending' THEN status WHEN sel THEN 'applied' ELSE 'rejected' END AS what FROM pr UNION ALL SELECT decision_id, 'live ' || coalesce((SELECT arg_max('t' || p, p) FROM go WHERE action = 'edit' AND d = decision_id), text) FROM decs WHERE decision_id NOT IN (SELECT d FROM go WHERE action = 'remove') UNION ALL SELECT (SELECT max(decision_id) FROM decs) + row_number() OVER (ORDER BY p), 'live t' || p FROM go WHERE action = 'add'", "decs", pr=_PROPS, go="SELECT * FROM pr WHERE sel AND status = 'pending'"))
def apply_proposals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    e = V.table(spark, sf, "events")
    props = e.select(k.alias("proposal_id"), F.when(k % 6 == 5, "applied").otherwise("pending").alias("status"), F.element_at(F.array(F.lit("add"), F.lit("edit"), F.lit("remove")), (k % 3 + 1).cast("int")).alias("action"), (k * 7 % 5000).alias("decision_id"), F.lit(None).cast("string").alias("category"), text("t", k).alias("text"), F.lit(None).cast("string").alias("detail"))
    after, live, _ = changes.apply_proposals(props, props.where("proposal_id % 2 = 0").select("proposal_id"), V.decisions(spark, sf))
    return after.select(F.col("proposal_id").alias("id"), F.col("status").alias("what")).unionByName(live.select(F.col("decision_id").alias("id"), text("live ", F.col("text")).alias("what")))


# The map.


_MODDOC = "SELECT 'n' || c_custkey AS key, c_custkey AS k, 'C' || c_custkey AS name FROM customer"


@register(query("SELECT a.name AS source, b.name AS target, edge_type, label FROM (SELECT key AS s, 'n' || (k + 1) AS t, 'communicates_via' AS edge_type, CASE WHEN k % 2 = 0 THEN 'p: ' ELSE 'calls ' END AS pre FROM m UNION ALL SELECT key, 'n' || (k * 7 % 151), 'depends_on', 'uses ' FROM m WHERE k % 3 <> 0 UNION ALL SELECT 'n' || (k + 2), key, 'depends_on', 'uses ' FROM m WHERE k % 5 = 0 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.k = m.k + 2 AND x.k % 3 <> 0 AND x.k * 7 % 151 = m.k)) JOIN m a ON a.key = s JOIN m b ON b.key = t, LATERAL (SELECT pre || b.name AS label)", m=_MODDOC))
def ingest_modules(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as modules of one published document that comes by sections, with relationships and consumers."""
    k = F.col("c_custkey")
    relation = lambda t, kind, protocol: F.struct(t.alias("targetModuleId"), F.lit(kind).alias("type"), protocol.alias("protocol"))
    via = relation(text("n", k + 1), "communicates_via", F.when(k % 2 == 0, "p").otherwise(""))
    uses = F.when(k % 3 != 0, relation(text("n", k * 7 % 151), "depends_on", F.lit(None).cast("string")))
    module = F.struct(text("n", k).alias("id"), text("C", k).alias("name"), F.when(k % 5 == 0, "shared-library").otherwise("module").alias("classification"), F.filter(F.array(via, uses), lambda x: x.isNotNull()).alias("relationships"), F.when(k % 5 == 0, F.array(text("n", k + 2))).alias("consumedBy"))
    out = maptables.with_module_edges(maptables.ingest_sections(V.table(spark, sf, "customer").select(k.alias("ord"), F.to_json(module).alias("value"))))
    names = out["modules"].select("module_id", "name")
    rows = out["module_edges"].join(names.select(F.col("module_id").alias("source_id"), F.col("name").alias("source")), "source_id").join(names.select(F.col("module_id").alias("target_id"), F.col("name").alias("target")), "target_id")
    return rows.select("source", "target", "edge_type", F.get_json_object("metadata", "$.label").alias("label"))


@register(query("SELECT component_id, path FROM cfiles WHERE NOT (length(path) % 3 = 0 AND component_id % 2 = 0) UNION ALL SELECT component_id + 1, path FROM cfiles WHERE length(path) % 3 = 0 AND component_id % 2 = 0", "cfiles"))
def move_files(spark: SparkSession, sf: str) -> DataFrame:
    f = V.component_files(spark, sf)
    moves = f.where("length(path) % 3 = 0").select("component_id", "path", F.when(F.col("component_id") % 2 == 0, F.col("component_id") + 1).alias("target_id"))
    return maptables.move_files(f, moves).select("component_id", "path")


@register(query("SELECT 'component' AS kind, component_id AS id, component_id IN (SELECT component_id FROM decs WHERE decision_id % 50 = 1 AND component_id IS NOT NULL) AS changed, component_id IN (SELECT component_id FROM decs JOIN outc USING (decision_id) WHERE status NOT IN ('confirmed', 'unchanged') AND component_id IS NOT NULL) AS revalidated FROM comps", "comps", "decs", "outc"))
def flag_nodes(spark: SparkSession, sf: str) -> DataFrame:
    d = V.decisions(spark, sf)
    own = d.select("decision_id", "component_id").withColumn("module_id", F.lit(None).cast("long"))
    nodes = V.components(spark, sf).select(F.lit("component").alias("kind"), F.col("component_id").alias("id"))
    return maptables.flag_nodes(nodes, own.where("decision_id % 50 = 1"), V.outcomes(spark, sf).select("decision_id", "status").join(own, "decision_id"))


@register(query("SELECT classification, count(*) AS modules FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'module' ELSE 'shared-library' END AS classification FROM customer) GROUP BY 1"))
def overview_totals(spark: SparkSession, sf: str) -> DataFrame:
    return maptables.overview_totals(V.table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "module").otherwise("shared-library").alias("classification")))


_NEWF = "SELECT c_nationkey AS m, 'm' || c_nationkey || '/f' || c_custkey || '.py' AS path, c_custkey AS k FROM customer"


@register(query("SELECT path, CASE WHEN k % 4 = 0 THEN 'NATION_' || m ELSE 'Fresh' || (k % 2) END AS component FROM f WHERE k % 4 <> 3", f=_NEWF))
def classify_new_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as new files of their nation: to its component, to new ones, and to one that isn't known."""
    k = F.col("c_custkey")
    f = V.table(spark, sf, "customer").select(key_of("c_nationkey").alias("module_id"), text("m", F.col("c_nationkey"), "/f", k, ".py").alias("path"), k.alias("k"))
    comps = V.components(spark, sf).select(F.col("component_id").alias("module_id"), "component_id", text("NATION_", F.col("component_id")).alias("name"))
    k = F.col("k") % 4
    answers = f.select("module_id", "path", F.when(k == 0, text("NATION_", F.col("module_id"))).when(k == 3, "Unknown").alias("existing_component"), F.when(k.isin(1, 2), text("Fresh", F.col("k") % 2)).alias("new_component"), F.lit("why").alias("purpose"))
    files, fresh, _ = maptables.apply_classification(f.select("module_id", "path"), comps, answers)
    every = comps.select("component_id", F.col("name").alias("component")).unionByName(fresh.select("component_id", F.col("name").alias("component")))
    return files.join(every, "component_id").select("path", "component")


@register(query("SELECT row_number() OVER (ORDER BY event_id) AS ticket_id, 'T' || event_id || chr(10) || 'x' AS title, 'd' || event_id AS description, CASE WHEN event_id % 2 = 0 THEN event_id END AS change_id FROM events WHERE event_id % 4 <> 0"))
def build_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """An answer an event, every fourth of them a correction of the map."""
    k = F.col("event_id")
    body = F.to_json(F.array(F.struct(F.array(text("T", k), F.lit("x")).alias("title"), text("d", k).alias("description"), (k % 4 == 0).alias("is_map_correction"), F.array(k, k + 1).alias("change_record_ids"))))
    e = V.table(spark, sf, "events")
    tickets, _, links, _ = maptables.build_tickets(e.select(k.alias("request_id"), body.alias("json")), e.where("event_id % 2 = 0").select(k.alias("change_id")))
    links = links.join(tickets.select("ticket_id", F.regexp_extract("description", "[0-9]+", 0).cast("long").alias("own")), "ticket_id").where("change_id = own")
    return tickets.join(links.select("ticket_id", "change_id"), "ticket_id", "left").select("ticket_id", "title", "description", "change_id")


# Text.


@register(query("SELECT source, string_agg('--- file: ' || doc_id || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY CAST(doc_id AS VARCHAR)) AS body, b AS batch_no FROM (SELECT source, doc_id, text, doc_id // 100 AS b FROM documents) GROUP BY source, b"))
def render_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 100).alias("batch_no"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return textbatch.render_batches(rows, "source")


@register(
    query(
        """SELECT module_id, name, component_id, decision_id, line, row_number() OVER (PARTITION BY module_id ORDER BY name, component_id, kind, decision_id) AS pos FROM (
        SELECT module_id, name, component_id, decision_id, 2 AS kind, '[' || decision_id || '] (' || category || ') ' || text AS line FROM d WHERE module_id IN (SELECT module_id FROM own GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT module_id, name, component_id, CAST(NULL AS BIGINT), 1, '## ' || name FROM own WHERE k > 1 UNION ALL SELECT module_id, name, component_id, CAST(NULL AS BIGINT), 0, '' FROM own WHERE k > 1 AND r > 1)""",
        "decs", "comps",
        d="SELECT c.module_id, c.name, component_id, decision_id, category, text FROM decs d JOIN comps c USING (component_id)",
        own="SELECT module_id, name, component_id, count(*) OVER (PARTITION BY module_id) AS k, row_number() OVER (PARTITION BY module_id ORDER BY name, component_id) AS r FROM (SELECT DISTINCT module_id, name, component_id FROM d)",
    )
)
def elevation_requests(spark: SparkSession, sf: str) -> DataFrame:
    return documents.elevation_lines(V.decisions(spark, sf), V.components(spark, sf))


@register(
    query(
        """SELECT c.component_id, source = 'human' AS human, decision_id, '[' || decision_id || '] (' || category || ') ' || text AS line, row_number() OVER (PARTITION BY c.component_id, source = 'human' ORDER BY decision_id) AS pos, f.n AS files
        FROM comps c JOIN decs d ON d.component_id = c.component_id JOIN (SELECT component_id, count(DISTINCT path) AS n FROM cfiles WHERE NOT is_test GROUP BY 1) f ON f.component_id = c.component_id""",
        "comps", "decs", "cfiles",
    )
)
def validation_requests(spark: SparkSession, sf: str) -> DataFrame:
    return documents.validation_lines(V.components(spark, sf), V.component_files(spark, sf), V.decisions(spark, sf))


_SHOWN = "CASE WHEN {0} IS NOT NULL THEN '   {1}: [k] ' || regexp_extract({0}, '\"k\": ([0-9]+)', 1) END"
_LINES = f"SELECT n, unnest([0, 1, 2]) AS part, unnest([n || '. ' || upper(action) || ' ' || entity_type || ' on component \"' || CASE WHEN module_id % 2 = 0 THEN 'c' || module_id ELSE 'unknown component' END || '\" (module: ' || CASE WHEN module_id % 3 = 0 THEN 'm' || module_id ELSE 'unknown module' END || ')', {_SHOWN.format('old_value', 'Was')}, {_SHOWN.format('new_value', 'Now')}]) AS line FROM (SELECT *, row_number() OVER (ORDER BY entity_type, entity_id) AS n FROM ({_NET_SQL}))"


@register(f"SELECT n, CAST(part AS INTEGER) AS part, line FROM ({_LINES}) WHERE line IS NOT NULL")
def ticket_request(spark: SparkSession, sf: str) -> DataFrame:
    """All net changes with what was and is now, by lines."""
    net, of = changes.collapse_changes(V.changes(spark, sf)), F.col("module_id")
    value = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.lit("k").alias("category"), F.get_json_object(c, "$.k").alias("text"))))
    net = net.withColumns({"old_value": value("old_value"), "new_value": value("new_value"), "component_name": F.when(of % 2 == 0, text("c", of)), "module_name": F.when(of % 3 == 0, text("m", of))})
    return textbatch.ticket_lines(net).select("n", "part", "line")


@register(query("SELECT CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens, CAST(sum(user_id + event_id) AS BIGINT) AS total_tokens FROM events"))
def usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return textbatch.usage_stats(V.table(spark, sf, "events").select(F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens")))


@register(
    query(
        "SELECT component_id, first, id, part, line, row_number() OVER (PARTITION BY component_id ORDER BY first, kind, id, part) AS pos FROM x",
        "decs",
        g="SELECT component_id, category, min(decision_id) AS first FROM decs WHERE component_id IS NOT NULL GROUP BY ALL",
        x="""SELECT component_id, first, 0 AS kind, CAST(NULL AS BIGINT) AS id, 0 AS part, '#### ' || category AS line FROM g UNION ALL SELECT component_id, first, 2, NULL, 1, '' FROM g
        UNION ALL SELECT component_id, first, 1, decision_id, 0, '- ' || text || ' *(source: ' || source || ')*' FROM decs JOIN g USING (component_id, category)
        UNION ALL SELECT component_id, first, 1, decision_id, 1, CASE WHEN detail <> '' THEN '  > ' || detail ELSE '' END FROM decs JOIN g USING (component_id, category)
        UNION ALL SELECT component_id, first, 1, decision_id, 2, '' FROM decs JOIN g USING (component_id, category) WHERE detail <> ''""",
    )
)
def render_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return documents.decision_lines(V.decisions(spark, sf).where("component_id is not null"), "component_id")


_DOC = r"""SELECT doc_id, text, trim(regexp_extract(array_to_string(list_slice(string_split(chr(34) || chr(34) || chr(34) || text || chr(34) || chr(34) || chr(34), chr(10)), 1, 50), chr(10)), '(?s)^\s*\x22\x22\x22(.*?)\x22\x22\x22', 1), ' ') AS t FROM documents"""


@register(query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS lines, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END ELSE '' END AS doc FROM t", t=_DOC))
def docstrings(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in triple quotes, half of them as docstrings of Python files; long ones don't end within 50 lines."""
    d = V.table(spark, sf, "documents")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a.py").otherwise("a.js").alias("path"), F.concat(F.lit('"""'), "text", F.lit('"""')).alias("quoted"), "text")
    return rows.select("doc_id", textbatch.line_count("text").cast("long").alias("lines"), textbatch.docstring("quoted").alias("doc"))


@register(query("SELECT kind, detail FROM (SELECT 'not clustered' AS kind, path AS detail FROM pfiles WHERE length(path) % 5 = 0 UNION ALL SELECT 'not a source file', 'x' || s_suppkey FROM supplier)", "pfiles"))
def check_clustering(spark: SparkSession, sf: str) -> DataFrame:
    f = V.part_files(spark, sf)
    more = V.table(spark, sf, "supplier").select(text("x", F.col("s_suppkey")).alias("path"), F.lit("Brand#11").alias("component"))
    return checks.check_clustering(f.select("path"), f.where("length(path) % 5 <> 0").unionByName(more), 1, 50)


@register(query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, min(CAST(l_linenumber AS BIGINT)) AS l_linenumber, CAST(NULL AS DOUBLE) AS extra FROM lineitem GROUP BY 1"))
def upgrade_table(spark: SparkSession, sf: str) -> DataFrame:
    schema = readers.T.StructType.fromDDL("l_orderkey string, l_linenumber bigint, extra double")
    return checks.upgrade_table(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), schema, ["l_orderkey"])


@register(query("SELECT index_id, total, 0 AS empty, 0 AS local, total AS non_local FROM (SELECT 'idx' AS index_id, count(*) AS total FROM lineitem)"))
def occurrence_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = diagnostics.occurrence_totals(V.occurrences(spark, sf))
    return rows.withColumns({c: F.col(c).cast("int") for c in ("empty", "local")})
