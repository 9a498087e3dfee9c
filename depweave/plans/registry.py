"""All queries over the given tables and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions import paths, symbols
from depweave.operators import changes, checks, cluster, components, diagnostics, documents, maptables, resolution, rollup, textbatch, versions, weights
from depweave.plans import views as V
from depweave.plans.sql import DIR, TEST, query
from depweave.sources import languages, readers, scratch
from depweave.streaming import collapse

QUERIES: dict = {}
SQL: dict = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _code(spark, sf):
    """The occurrences, written once for all that a query reads of them."""
    return scratch.cut(V.occurrences(spark, sf), "occurrences")


def _edges(spark, sf, occ=None):
    occ = _code(spark, sf) if occ is None else occ
    return resolution.file_edges(occ, V.symbols(spark, sf, occ))


def _nodes(spark, sf, occ=None):
    occ = V.occurrences(spark, sf) if occ is None else occ
    return scratch.cut(occ.select(F.col("relative_path").alias("node")).distinct(), "nodes")


def _weighted(spark, sf, occ=None):
    return weights.combine_weights(_edges(spark, sf, occ))


def _r(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


# Symbols and resolution.


@register(query("SELECT symbol, path FROM defs", "defs"))
def definitions(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.definitions(V.occurrences(spark, sf)).select("symbol", "path")


@register(query("SELECT symbol, kind FROM kinds", "kinds"))
def symbol_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.symbol_kinds(V.symbols(spark, sf)).select("symbol", "kind")


@register(query("SELECT symbol, path, count(*) AS n, bool_and(roles % 2 = 1) AS all_definitions, bool_or(CASE WHEN kind <> 0 THEN kind IN (17, 26, 9) ELSE ends_with(symbol, '().') END) AS callable FROM occ GROUP BY ALL", "occ"))
def symbol_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols.with_symbol_flags(V.occurrences(spark, sf))
    return rows.groupBy("symbol", F.col("relative_path").alias("path")).agg(F.count("*").alias("n"), F.bool_and("is_definition").alias("all_definitions"), F.bool_or("is_callable").alias("callable"))


_SYMBOL = """'scheme py pkg `src/m' || (l_partkey % 7) || CASE WHEN l_orderkey % 2 = 0 THEN '/core`/' ELSE '`/' END || CASE l_orderkey % 5 WHEN 0 THEN 'f' || l_suppkey || '(a).' WHEN 1 THEN 'C' || l_suppkey || '#' WHEN 2 THEN 'C' || l_suppkey || '#m().' WHEN 3 THEN 'x' || l_suppkey || '.' ELSE '' END"""


@register(
    query(
        "SELECT DISTINCT symbol, CASE WHEN n = '' THEN symbol ELSE n END AS name, split_part(symbol, '`', 2) AS module FROM (SELECT symbol, rtrim(regexp_replace(regexp_extract(rtrim(symbol, '.'), '[^/]*$'), '\\([^)]*\\)\\.$', ''), '#') AS n FROM s)",
        s=f"SELECT {_SYMBOL} AS symbol FROM lineitem",
    )
)
def symbol_names(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as functions, classes, methods, variables and modules of packages."""
    rows = V.table(spark, sf, "lineitem").select(F.expr(_SYMBOL).alias("symbol"))
    return rows.select("symbol", symbols.symbol_name().alias("name"), symbols.symbol_module().alias("module")).distinct()


@register(query("SELECT path, symbol, def_path, cnt, callable FROM resolved", "resolved"))
def resolve_references(spark: SparkSession, sf: str) -> DataFrame:
    occ = _code(spark, sf)
    return resolution.resolve_references(occ, kinds=resolution.symbol_kinds(V.symbols(spark, sf, occ))).select("path", "symbol", "def_path", "cnt", "callable")


@register(query("SELECT p.path, d.path AS def_path, count(*) AS cnt FROM (SELECT p_brand || '/' || p_type || '/p' || p_partkey || '.py' AS path, 'o' || (p_partkey * 3) AS target FROM part) p JOIN defs d ON d.symbol = p.target WHERE p.path <> d.path GROUP BY ALL", "defs"))
def resolve_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.resolve_inheritance(V.relationships(spark, sf), V.occurrences(spark, sf)).select("path", "def_path", "cnt")


@register(query("SELECT src, dst, edge_type, cnt FROM fedges", "fedges"))
def file_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("src", "dst", "edge_type", "cnt")


@register(query("SELECT src, dst, edge_type, cnt FROM fedges", "fedges"))
def merge_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of even and of odd customers as two indexes: all lines of an order are in one of them."""
    occ = _code(spark, sf)
    sym = V.symbols(spark, sf, occ)
    even = F.endswith("symbol", F.lit("()."))
    return resolution.merge_indexes([resolution.file_edges(occ.where(c), sym.where(c)).select("src", "dst", "edge_type", "cnt") for c in (even, ~even)])


@register(query("SELECT (SELECT count(*) FROM defs) AS n_definitions, CAST(2 AS BIGINT) AS n_indexes, (SELECT count(*) FROM nodes) AS n_files, (SELECT count(*) FROM fedges) AS n_edges", "defs", "nodes", "fedges"))
def merge_index_results(spark: SparkSession, sf: str) -> DataFrame:
    """The same two indexes and one without files: files joined, definitions added up."""
    occ = _code(spark, sf)
    sym = V.symbols(spark, sf, occ)
    even = F.endswith("symbol", F.lit("()."))
    parts = []
    for c in (even, ~even, F.lit(False)):
        files = occ.where(c).select(F.col("relative_path").alias("path"))
        parts.append((resolution.file_edges(occ.where(c), sym.where(c)), files, resolution.index_stats(occ.where(c), files)))
    edges, _, stats = resolution.merge_index_results(parts)
    return stats.join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))


@register(query("SELECT (SELECT count(*) FROM defs) AS n_definitions, count(*) AS n_files FROM nodes", "defs", "nodes"))
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    occ = V.occurrences(spark, sf)
    return resolution.index_stats(occ, occ.select(F.col("relative_path").alias("path"))).select("n_definitions", "n_files")


# The weighted graph.


@register(query("SELECT src, dst, round(weight, 6) AS weight FROM weighted", "weighted"))
def combined_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted(spark, sf).select("src", "dst", *_r("weight"))


@register(query("SELECT node, degree FROM deg", "deg"))
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return weights.degrees(_weighted(spark, sf))


@register(
    query(
        "SELECT src, dst, round(weight, 6) AS weight FROM weighted JOIN deg a ON a.node = src JOIN deg b ON b.node = dst WHERE NOT ((SELECT v FROM avg_deg) >= 6.0 AND round(weight, 9) < 0.5 AND a.degree <= (SELECT degree FROM med) AND b.degree <= (SELECT degree FROM med))",
        "deg",
        avg_deg="SELECT avg(degree) AS v FROM deg",
        med="SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS p, count(*) OVER () AS n FROM deg) WHERE p = n // 2",
    )
)
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = _weighted(spark, sf).withColumn("weight", F.round("weight", 9))
    return weights.drop_noise(e).select("src", "dst", *_r("weight"))


_DIRS = {"d": f"SELECT node, {DIR.format('node')} AS dir FROM nodes", "s": "SELECT dir, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2"}


@register(
    query(
        """SELECT a.node AS src, b.node AS dst, round(CASE WHEN n <= 4 THEN 2.0 ELSE 2.0 / log2(n) END, 6) AS weight FROM d a JOIN d b USING (dir) JOIN s USING (dir) WHERE n <= 10 AND a.node < b.node
        UNION ALL SELECT least(node, '__dir__/' || dir), greatest(node, '__dir__/' || dir), round(2.0 / log2(n), 6) FROM d JOIN s USING (dir) WHERE n > 10""",
        "nodes", **_DIRS,
    )
)
def dir_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return weights.directory_affinity(_nodes(spark, sf)).select("src", "dst", *_r("weight"))


@register(
    query(
        """SELECT src, dst, round(weight / (CASE WHEN a.degree > t THEN sqrt(a.degree / CAST(t AS DOUBLE)) ELSE 1 END * CASE WHEN b.degree > t THEN sqrt(b.degree / CAST(t AS DOUBLE)) ELSE 1 END), 6) AS weight
        FROM weighted JOIN deg a ON a.node = src JOIN deg b ON b.node = dst, th""",
        "deg", "nodes",
        th="SELECT greatest(2, degree) AS t FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS p, count(*) OVER () AS n FROM (SELECT coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node))) WHERE p = n * 90 // 100",
    )
)
def hub_dampening(spark: SparkSession, sf: str) -> DataFrame:
    occ = _code(spark, sf)
    return weights.dampen_hubs(_weighted(spark, sf, occ), _nodes(spark, sf, occ)).select("src", "dst", *_r("weight"))


@register(query("SELECT part, n, round(CASE WHEN n <= 50 THEN 1.0 ELSE least(1.0 + 0.5 * log2(n / 50.0), 2.0) END, 6) AS resolution FROM (SELECT split_part(node, '/', 1) AS part, count(*) AS n FROM nodes GROUP BY 1)", "nodes"))
def auto_resolution(spark: SparkSession, sf: str) -> DataFrame:
    rows = _nodes(spark, sf).withColumn("part", F.split_part("node", F.lit("/"), F.lit(1)))
    return weights.auto_resolution(rows, by="part").select("part", "n", *_r("resolution"))


@register(
    query(
        "SELECT source, target, edge_type, cnt, round(raw, 6) AS weight_raw, round(raw * 10 / max(raw) OVER (), 1) AS weight FROM r",
        "fedges", "pfiles",
        p="SELECT least(a.component, b.component) AS source, greatest(a.component, b.component) AS target, edge_type, CAST(sum(cnt) AS BIGINT) AS cnt FROM fedges JOIN pfiles a ON a.path = src JOIN pfiles b ON b.path = dst WHERE a.component <> b.component GROUP BY 1, 2, 3",
        n="SELECT component, count(*) AS n FROM pfiles GROUP BY 1",
        r="SELECT source, target, edge_type, cnt, cnt / sqrt(CAST(a.n * b.n AS DOUBLE)) AS raw FROM p JOIN n a ON a.component = source JOIN n b ON b.component = target",
    )
)
def rollup_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.rollup_edges(_edges(spark, sf), V.part_files(spark, sf)).select("source", "target", "edge_type", "cnt", *_r("weight_raw"), "weight")


# Clusters.


def _assign(spark, sf, occ=None):
    """Brands as clusters."""
    return _nodes(spark, sf, occ).withColumn("cluster", F.regexp_extract("node", "#([0-9]+)/", 1).cast("int"))


_A = "SELECT node, CAST(regexp_extract(node, '#([0-9]+)/', 1) AS INTEGER) AS cluster FROM nodes"
_CALLS = "SELECT src AS node, dst AS other, cnt FROM fedges WHERE edge_type = 'call' UNION ALL SELECT dst, src, cnt FROM fedges WHERE edge_type = 'call'"


def _calls(spark, sf, occ=None):
    return _edges(spark, sf, occ).where("edge_type = 'call'").select("src", "dst", "cnt")


@register(
    query(
        "SELECT a.node, CASE WHEN t.own / t.total < 0.4 AND b.k / t.total >= 0.6 THEN b.c ELSE a.cluster END AS cluster FROM a LEFT JOIN t USING (node) LEFT JOIN b USING (node)",
        "fedges", "nodes", a=_A, calls=_CALLS,
        s="SELECT x.node, m.cluster AS mine, o.cluster AS c, CAST(sum(cnt) AS DOUBLE) AS k FROM calls x JOIN a m ON m.node = x.node JOIN a o ON o.node = x.other GROUP BY ALL",
        t="SELECT node, sum(k) AS total, sum(CASE WHEN c = mine THEN k ELSE 0 END) AS own FROM s GROUP BY 1",
        b="SELECT node, c, k FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY k DESC, c) AS rn FROM s WHERE c <> mine) WHERE rn = 1",
    )
)
def redistribute(spark: SparkSession, sf: str) -> DataFrame:
    occ = _code(spark, sf)
    return cluster.redistribute(_assign(spark, sf, occ), _calls(spark, sf, occ)).select("node", "cluster")


@register(
    query(
        "SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY f) > 1 THEN f || '_' || row_number() OVER (PARTITION BY f ORDER BY cluster) ELSE f END AS name FROM g",
        "nodes", a=_A,
        l="SELECT cluster, leaf, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, leaf) AS rn FROM (SELECT cluster, split_part(node, '/', 2) AS leaf FROM a) GROUP BY cluster, leaf",
        u="SELECT cluster, up, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, up) AS rn FROM (SELECT cluster, split_part(node, '/', 1) AS up FROM a) GROUP BY cluster, up",
        g="SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY leaf) > 1 THEN up || '/' || leaf ELSE leaf END AS f FROM l JOIN u USING (cluster) WHERE l.rn = 1 AND u.rn = 1",
    )
)
def name_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return components.name_clusters(_assign(spark, sf))


@register(
    query(
        """SELECT d.node, CASE WHEN (SELECT count(*) FROM z WHERE n >= 12) = 0 THEN '__all__' WHEN z.n >= 12 THEN d.dir
        WHEN (SELECT sum(n) FROM z WHERE n < 12) < 12 THEN (SELECT dir FROM z WHERE n >= 12 ORDER BY n, dir LIMIT 1) ELSE '__pool__' END AS partition FROM d JOIN z USING (dir)""",
        "nodes", d=_DIRS["d"], z="SELECT dir, count(*) AS n FROM d GROUP BY 1",
    )
)
def partition_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.partition_nodes(_nodes(spark, sf), min_size=12)


@register(
    query(
        "SELECT round(sum(inner_w / m - (k / (2 * m)) ** 2), 6) AS q FROM c, (SELECT sum(k) / 2 AS m FROM c)",
        "weighted", "nodes", a=_A,
        e="SELECT weight, x.cluster AS a, y.cluster AS b FROM weighted JOIN a x ON x.node = src JOIN a y ON y.node = dst",
        c="SELECT cl, sum(w) AS k, sum(i) AS inner_w FROM (SELECT a AS cl, weight AS w, CASE WHEN a = b THEN weight / 2 ELSE 0 END AS i FROM e UNION ALL SELECT b, weight, CASE WHEN a = b THEN weight / 2 ELSE 0 END FROM e) GROUP BY 1",
    )
)
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    occ = _code(spark, sf)
    return cluster.modularity(_weighted(spark, sf, occ), _assign(spark, sf, occ)).select(*_r("q"))


@register(
    query(
        "SELECT a.node, coalesce(CASE WHEN r.rn > 5 THEN coalesce(b.k, (SELECT cluster FROM r WHERE rn <= 5 ORDER BY n, cluster LIMIT 1)) END, a.cluster) AS cluster FROM a JOIN r USING (cluster) LEFT JOIN b ON b.s = a.cluster",
        "nodes", a=_A,
        r="SELECT cluster, n, row_number() OVER (ORDER BY n DESC, cluster) AS rn FROM (SELECT cluster, count(*) AS n FROM a GROUP BY 1)",
        px="SELECT DISTINCT cluster, split_part(node, '/', 2) AS p FROM a",
        pc="SELECT cluster, count(*) AS c FROM px GROUP BY 1",
        j="SELECT x.cluster AS s, y.cluster AS k, y2.n, count(*) AS shared FROM px x JOIN r x2 ON x2.cluster = x.cluster AND x2.rn > 5 JOIN px y ON y.p = x.p JOIN r y2 ON y2.cluster = y.cluster AND y2.rn <= 5 GROUP BY ALL",
        b="SELECT s, k FROM (SELECT s, k, row_number() OVER (PARTITION BY s ORDER BY shared / CAST(u.c + v.c - shared AS DOUBLE) DESC, n, k) AS rn FROM j JOIN pc u ON u.cluster = s JOIN pc v ON v.cluster = k) WHERE rn = 1",
    )
)
def merge_small_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Paths without their brand, so that clusters share prefixes."""
    rows = _assign(spark, sf)
    short = rows.withColumn("full", F.col("node")).withColumn("node", F.regexp_replace("node", "^[^/]*/", ""))
    # 25 clusters and a target of 5: more than three times the target.
    return cluster.merge_small_clusters(short, 5).select(F.col("full").alias("node"), "cluster")


@register(query("SELECT node, CAST(dense_rank() OVER (ORDER BY p, c) - 1 AS INTEGER) AS cluster FROM (SELECT node, split_part(node, '/', 2) AS p, CAST(regexp_extract(node, '#([0-9]+)/', 1) AS INTEGER) % 3 AS c FROM nodes)", "nodes"))
def globalise_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = _assign(spark, sf).select("node", F.split_part("node", F.lit("/"), F.lit(2)).alias("partition"), (F.col("cluster") % 3).alias("cluster"))
    return cluster.globalise_ids(rows).select("node", "cluster")


@register(
    query(
        "SELECT node, component FROM cc",
        "weighted", "nodes", ends="SELECT src AS a, dst AS b FROM weighted UNION ALL SELECT dst, src FROM weighted",
        **{"cc(node, component) USING KEY (node)": "SELECT node, node FROM nodes UNION SELECT e.b, min(c.component) FROM cc c JOIN ends e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b"},
    )
)
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    occ = _code(spark, sf)
    return cluster.connected_components(_weighted(spark, sf, occ), _nodes(spark, sf, occ))


@register()
def communities(spark: SparkSession, sf: str) -> DataFrame:
    occ = _code(spark, sf)
    return cluster.communities(_weighted(spark, sf, occ), _nodes(spark, sf, occ))


@register()
def communities_targeted(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.communities_targeted(_weighted(spark, sf), _nodes(spark, sf), 20)


@register()
def discover_components(spark: SparkSession, sf: str) -> DataFrame:
    occ = _code(spark, sf)
    return components.discover(occ, V.symbols(spark, sf, occ), V.relationships(spark, sf))["component_edges"].select("source", "target", "edge_type", "cnt", "weight")


@register(
    query(
        "SELECT t.path, coalesce(b.c, m.c, 'unassigned') AS component, CASE WHEN b.c IS NOT NULL THEN 'calls' WHEN m.c IS NOT NULL THEN 'name' ELSE 'unassigned' END AS how FROM t LEFT JOIN b USING (path) LEFT JOIN m USING (path)",
        t="SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'tests/test_NATION_' || s_nationkey || '.py' WHEN 1 THEN 'tests/test_c' || s_suppkey || '_' || s_nationkey || '.py' WHEN 2 THEN 'NATION_' || s_nationkey || '/check_' || s_suppkey || '.py' ELSE 'tests/x' || s_suppkey || '.py' END AS path FROM supplier",
        src="SELECT 'n' || c_nationkey AS c, 'nation_' || c_nationkey || '/c' || c_custkey || '/' || (c_custkey % 30) || '.py' AS path FROM customer",
        calls="SELECT t.path, src.path AS other, 1 + length(src.path) % 3 AS k FROM t JOIN src ON regexp_extract(t.path, '[0-9]+') = regexp_extract(src.path, '/c([0-9]+)/', 1) WHERE t.path LIKE 'tests/x%'",
        b="SELECT path, c FROM (SELECT calls.path, c, row_number() OVER (PARTITION BY calls.path ORDER BY sum(k) DESC, c) AS rn FROM calls JOIN src ON src.path = other GROUP BY calls.path, c) WHERE rn = 1",
        w="SELECT path, CASE WHEN starts_with(stem, 'test_') THEN substr(stem, 6) ELSE '' END AS subj, folder FROM (SELECT path, lower(regexp_extract(path, '([^/]*)[.]py$', 1)) AS stem, lower(split_part(path, '/', 1)) AS folder FROM t)",
        names="SELECT path, unnest([subj, CASE WHEN contains(subj, '_') THEN split_part(subj, '_', 1) ELSE '' END, CASE WHEN contains(subj, '_') THEN replace(subj, '_', '/') ELSE '' END, CASE WHEN folder = 'tests' THEN '' ELSE folder END]) AS name FROM w",
        m="SELECT path, c FROM (SELECT x.path, c, row_number() OVER (PARTITION BY x.path ORDER BY count(DISTINCT src.path) DESC, c) AS rn FROM names x JOIN src ON x.name <> '' AND contains(lower(src.path), x.name) GROUP BY x.path, c) WHERE rn = 1",
    )
)
def assign_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as test files of four kinds, customers as source files of their nation."""
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    path = F.when(key % 4 == 0, text("tests/test_NATION_", nation, ".py")).when(key % 4 == 1, text("tests/test_c", key, "_", nation, ".py"))
    path = path.when(key % 4 == 2, text("NATION_", nation, "/check_", key, ".py")).otherwise(text("tests/x", key, ".py"))
    tests = V.table(spark, sf, "supplier").select(path.alias("path")).distinct()
    c = V.table(spark, sf, "customer")
    own = c.select(text("n", F.col("c_nationkey")).alias("component"), text("nation_", F.col("c_nationkey"), "/c", F.col("c_custkey"), "/", F.col("c_custkey") % 30, ".py").alias("path"))
    pairs = tests.where("path like 'tests/x%'").select(F.col("path").alias("src"), F.regexp_extract("path", "[0-9]+", 0).alias("k"))
    calls = pairs.join(own.select(F.col("path").alias("dst"), F.regexp_extract("path", "/c([0-9]+)/", 1).alias("k")), "k").select("src", "dst", (1 + F.length("dst") % 3).alias("cnt"))
    return components.assign_tests(tests, calls, own)


@register(
    query(
        "SELECT p.path, coalesce(b.target, p.component) AS component FROM pfiles p LEFT JOIN b USING (path)",
        "pfiles",
        s="SELECT path, 'Brand#' || (l_suppkey % 40) AS target, l_quantity AS confidence FROM lineitem JOIN (SELECT p_partkey, p_brand || '/' || p_type || '/p' || p_partkey || '.py' AS path FROM part) ON p_partkey = l_partkey",
        b="SELECT path, target FROM (SELECT path, target, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, target) AS rn FROM s) WHERE rn = 1 AND target IN (SELECT component FROM pfiles)",
    )
)
def reconcile_misplaced(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem")
    parts = V.table(spark, sf, "part").select("p_partkey", V.part_path().alias("path"))
    s = li.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("path", F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 40).cast("string")).alias("target"), F.col("l_quantity").alias("confidence"))
    return components.reconcile_misplaced(V.part_files(spark, sf), s).select("path", "component")


# Paths.


@register(query(f"SELECT path, {DIR.format('path')} AS dir, regexp_extract(path, '[^/]*$') AS name, regexp_matches(path, '{TEST}') AS is_test FROM rfiles", "rfiles"))
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = paths.with_path_parts(V.repo_files(spark, sf))
    return rows.select("path", "dir", paths.leaf("path").alias("name"), paths.is_test("path").alias("is_test"))


@register(query("SELECT path FROM rfiles WHERE starts_with(path, 'src/') OR starts_with(path, 'docs/api/')", "rfiles"))
def files_in_module(spark: SparkSession, sf: str) -> DataFrame:
    dirs = V.table(spark, sf, "region").select(F.element_at(F.array(F.lit("src"), F.lit("docs/api/"), F.lit("sr"), F.lit(""), F.lit("api")), F.col("r_regionkey") + 1).alias("directory"))
    return paths.files_in_module(V.repo_files(spark, sf), dirs)


@register(query("SELECT path FROM rfiles WHERE NOT (list_contains(string_split(path, '/'), 'node_modules') OR list_contains(string_split(path, '/'), 'build') OR path LIKE '%.min.js' OR regexp_matches(path, '^src/.*[.]rs$') OR regexp_matches(path, '[0-9]_[^a-l].*[.]h$') OR regexp_matches(path, '(^|/)[^/]..[.]py$'))", "rfiles"))
def exclude_globs(spark: SparkSession, sf: str) -> DataFrame:
    """Among them a star and a class that cross or meet directories, and texts that are no globs."""
    return paths.exclude_globs(V.repo_files(spark, sf), ["node_modules/**", "build/**", "*.min.js", "src/*.rs", "*[0-9]_[!a-l]*.h", "**/???.py", "a**", "[x"])


@register(query("SELECT o.path FROM rfiles o WHERE NOT EXISTS (SELECT 1 FROM rfiles t WHERE t.path = o.path AND length(t.path) % 2 = 0)", "rfiles"))
def new_files(spark: SparkSession, sf: str) -> DataFrame:
    f = V.repo_files(spark, sf)
    return paths.new_files(f, f.where(F.length("path") % 2 == 0))


@register(query("SELECT raw_path, arg_max(path, length(path)) AS path FROM (SELECT 'repo/' || a.path AS raw_path, b.path FROM rfiles a JOIN rfiles b ON a.path = b.path OR ends_with(a.path, '/' || b.path)) GROUP BY 1", "rfiles"))
def match_paths(spark: SparkSession, sf: str) -> DataFrame:
    f = V.repo_files(spark, sf)
    return paths.match_paths(f.select(F.concat(F.lit("repo/"), "path").alias("raw_path")), f)


@register(
    query(
        "SELECT language, source_files, coalesce(c, 0) AS config_files FROM s LEFT JOIN g USING (language)",
        "rfiles",
        f="SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1) AS ext FROM rfiles WHERE NOT (path LIKE '%node_modules%' OR starts_with(path, 'build/') OR path LIKE '%.min.js')",
        s="SELECT CASE ext WHEN 'py' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'rs' THEN 'Rust' WHEN 'ts' THEN 'TypeScript' WHEN 'h' THEN 'C' WHEN 'go' THEN 'Go' END AS language, count(*) AS source_files FROM f WHERE ext IN ('py', 'java', 'rs', 'ts', 'h', 'go') GROUP BY 1",
        g="SELECT CASE WHEN name = 'package.json' THEN 'JavaScript' ELSE 'C#' END AS language, count(*) AS c FROM f WHERE name = 'package.json' OR ext = 'csproj' GROUP BY 1",
    )
)
def language_report(spark: SparkSession, sf: str) -> DataFrame:
    return languages.language_report(V.repo_files(spark, sf))


@register(
    query(
        "SELECT lower(ext) AS ext, count(*) AS n FROM f WHERE ext <> '' AND ext NOT IN ('py', 'java', 'rs', 'ts', 'h', 'go', 'js') GROUP BY 1",
        "rfiles",
        f="SELECT regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]+)$', 1) AS ext FROM rfiles WHERE NOT (path LIKE '%node_modules%' OR starts_with(path, 'build/') OR path LIKE '%.min.js')",
    )
)
def unrecognised_extensions(spark: SparkSession, sf: str) -> DataFrame:
    return languages.unrecognised(V.repo_files(spark, sf))


# Changes and versions.

_KEYS = ("entity_type", "entity_id")
_NET = {
    "st": """SELECT entity_type, entity_id, count(*) AS n, first(action ORDER BY ord) AS fa, last(action ORDER BY ord) AS la, min(ord) AS o1, max(ord) AS o2 FROM ch GROUP BY 1, 2""",
    "ends": "SELECT st.*, f.old_value AS fo, l.new_value AS ln, f.module_id AS fm, l.module_id AS lm, CASE WHEN n = 1 THEN fa WHEN fa = 'add' THEN 'add' WHEN la = 'remove' THEN 'remove' ELSE 'edit' END AS action FROM st JOIN ch f ON f.ord = o1 JOIN ch l ON l.ord = o2",
}
_NET_SQL = query(
    """SELECT entity_type, entity_id, action, CASE WHEN n = 1 OR action <> 'add' THEN fo END AS old_value, CASE WHEN n = 1 OR action <> 'remove' THEN ln END AS new_value, CASE WHEN n > 1 AND action = 'remove' THEN lm ELSE fm END AS module_id
    FROM ends WHERE NOT (n > 1 AND ((fa = 'add' AND la = 'remove') OR (action = 'edit' AND fo IS NOT DISTINCT FROM ln)))""",
    "ch", **_NET,
)
_NET_COLS = [*_KEYS, "action", "old_value", "new_value", "module_id"]


@register(_NET_SQL)
def collapse_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.collapse_changes(V.changes(spark, sf)).select(_NET_COLS)


@register(_NET_SQL)
def stream_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """The change log, written out as files and taken in as a stream in several batches."""
    place = scratch.new_path(spark, "stream")
    log = V.changes(spark, sf)
    log.repartition(6, "entity_id").write.parquet(f"{place}/log")
    return collapse.stream_collapse(spark, f"{place}/log", log.schema, f"{place}/state", files_per_batch=2).select(_NET_COLS)


@register(query("SELECT entity_type, entity_id, ord FROM ch WHERE baseline_id = (SELECT max(baseline_id) FROM ch)", "ch"))
def changes_since(spark: SparkSession, sf: str) -> DataFrame:
    log = V.changes(spark, sf)
    return changes.changes_since(log, log.select("baseline_id").where("baseline_id is not null").distinct()).select("entity_type", "entity_id", "ord")


@register(
    query(
        "SELECT coalesce(a.decision_id, b.decision_id) AS decision_id, CASE WHEN a.decision_id IS NULL THEN 'add' WHEN b.decision_id IS NULL THEN 'remove' ELSE 'edit' END AS action FROM v1 a FULL JOIN v2 b ON a.decision_id = b.decision_id WHERE a.category IS DISTINCT FROM b.category OR a.text IS DISTINCT FROM b.text",
        "v1", "v2",
    )
)
def record_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.record_changes(V.version(spark, sf, 1), V.version(spark, sf, 2), ["decision_id"], "human", 1, ["category", "text"]).select("decision_id", "action")


@register(
    query(
        """SELECT coalesce(a.decision_id, b.decision_id) AS decision_id, CASE WHEN a.decision_id IS NULL THEN 'added' WHEN b.decision_id IS NULL THEN 'removed' WHEN a.category IS DISTINCT FROM b.category OR a.text IS DISTINCT FROM b.text THEN 'changed' ELSE 'unchanged' END AS change,
        CASE WHEN b.decision_id IS NOT NULL THEN b.module_name ELSE a.module_name END AS module_name, CASE WHEN b.decision_id IS NOT NULL THEN b.component_name ELSE a.component_name END AS component_name,
        a.category AS old_category, b.category AS new_category, a.text AS old_text, b.text AS new_text, a.source AS old_source, b.source AS new_source FROM v1 a FULL JOIN v2 b ON a.decision_id = b.decision_id""",
        "v1", "v2",
    )
)
def compare_versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions.compare_versions(V.version(spark, sf, 1), V.version(spark, sf, 2))


@register(query("SELECT d.*, coalesce(c.name, '') AS component_name, coalesce(m.name, '') AS module_name FROM decs d LEFT JOIN comps c ON c.component_id = d.component_id LEFT JOIN mods m ON m.module_id = d.module_id", "decs", "comps", "mods"))
def decisions_with_names(spark: SparkSession, sf: str) -> DataFrame:
    t = V.map_tables(spark, sf)
    return versions.decisions_with_names(t["decisions"], t["components"], t["modules"])


@register(query("SELECT d.decision_id, coalesce(d.module_id, c.module_id) AS owner_module_id FROM decs d LEFT JOIN comps c ON c.component_id = d.component_id", "decs", "comps"))
def owner_modules(spark: SparkSession, sf: str) -> DataFrame:
    t = V.map_tables(spark, sf)
    return versions.with_owner_module(t["decisions"], t["components"]).select("decision_id", "owner_module_id")


@register(query("SELECT CAST(4 AS BIGINT) AS version, d.decision_id, d.module_id, d.component_id, coalesce(m.name, '') AS module_name, coalesce(c.name, '') AS component_name, category, text, detail, source FROM decs d LEFT JOIN comps c ON c.component_id = d.component_id LEFT JOIN mods m ON m.module_id = d.module_id", "decs", "comps", "mods"))
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    t = V.map_tables(spark, sf)
    known = V.table(spark, sf, "nation").where("n_nationkey between 1 and 3").select(F.col("n_nationkey").cast("long").alias("version"))
    return versions.create_snapshot(t["decisions"], t["components"], t["modules"], known, "manual", "2024-01-01")[1]


@register(query("SELECT count(*) AS total, count(module_id) AS module_level, count(component_id) AS component_level, (SELECT count(*) FROM mods) AS modules, (SELECT count(*) FROM comps) AS components FROM decs", "decs", "mods", "comps"))
def snapshot_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = V.map_tables(spark, sf)
    return versions.snapshot_summary(t["decisions"], t["components"], t["modules"])


@register(
    query(
        "SELECT o.ord, o.status, d.module_id, d.component_id FROM outc o LEFT JOIN decs d ON d.decision_id = o.decision_id WHERE o.status NOT IN ('confirmed', 'unchanged') AND o.run_id = (SELECT run_id FROM vruns WHERE status = 'completed' ORDER BY created_at DESC, run_id DESC LIMIT 1)",
        "outc", "decs", "vruns",
    )
)
def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return versions.validation_summary(V.runs(spark, sf), V.outcomes(spark, sf), V.decisions(spark, sf))[1].select("ord", "status", "module_id", "component_id")


@register(query("SELECT run_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS \"{s}\"" for s in versions.STATUSES) + " FROM outc GROUP BY 1", "outc"))
def validation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return versions.validation_stats(V.outcomes(spark, sf))


@register(
    query(
        """SELECT decision_id, CASE WHEN source <> 'human' THEN coalesce((SELECT new_text FROM outc o WHERE o.status = 'updated' AND o.decision_id = d.decision_id ORDER BY ord DESC LIMIT 1), text) ELSE text END AS text, source FROM decs d
        UNION ALL SELECT (SELECT max(decision_id) FROM decs) + row_number() OVER (ORDER BY ord), new_text, 'pipeline_generated' FROM outc WHERE status = 'new'""",
        "outc", "decs",
    )
)
def apply_validations(spark: SparkSession, sf: str) -> DataFrame:
    o = V.outcomes(spark, sf).withColumns({"category": F.lit("patterns"), "module_id": F.lit(1).cast("long"), "component_id": F.lit(None).cast("long")})
    return versions.apply_validations(V.decisions(spark, sf), o).select("decision_id", "text", "source")


# The map.


@register(
    query(
        """SELECT 'module' AS entity_type, module_id AS id, name, '' AS owner FROM mods WHERE lower(name) LIKE '%rule__1_%'
        UNION ALL SELECT 'component', component_id, c.name, coalesce(m.name, '') FROM comps c LEFT JOIN mods m USING (module_id) WHERE lower(c.name) LIKE '%rule__1_%'
        UNION ALL SELECT 'decision', decision_id, text, CASE WHEN c.name IS NOT NULL THEN c.name ELSE coalesce(m.name, '') END FROM decs d LEFT JOIN comps c ON c.component_id = d.component_id LEFT JOIN mods m ON m.module_id = d.module_id WHERE lower(text) LIKE '%rule__1_%' OR coalesce(lower(detail) LIKE '%rule__1_%', false)""",
        "mods", "comps", "decs",
    )
)
def search_entities(spark: SparkSession, sf: str) -> DataFrame:
    t = V.map_tables(spark, sf)
    return maptables.search_entities(t["modules"], t["components"], t["decisions"], "Rule__1_")


@register(
    query(
        """SELECT module_id, name, classification, (SELECT count(*) FROM comps c WHERE c.module_id = m.module_id) AS components,
        (SELECT count(*) FROM decs d LEFT JOIN comps c ON c.component_id = d.component_id WHERE coalesce(d.module_id, c.module_id) = m.module_id) AS decisions FROM mods m""",
        "mods", "comps", "decs",
    )
)
def map_overview(spark: SparkSession, sf: str) -> DataFrame:
    t = V.map_tables(spark, sf)
    return maptables.map_overview(t["modules"], t["components"], t["decisions"])


_SAID = "to_json({'id': decision_id, 'category': category, 'text': text, 'detail': detail, 'source': source})"
_EDGE = "to_json({'source_id': source_id, 'target_id': target_id, 'edge_type': edge_type, 'weight': weight, 'metadata': CASE WHEN metadata = 'oops' THEN '{}' ELSE replace(metadata, ': ', ':') END})"
#: The pieces of the map: where each goes, its text, whether a comma goes before it, whether it opens a list.
_PIECES = [
    ("[0]", """'{"version":1,"map":{"modules":['""", "false", "true", "(SELECT 1)"),
    ("[1, module_id]", """rtrim(to_json({'id': module_id, 'name': name, 'classification': classification, 'type': NULL::VARCHAR, 'technology': NULL::VARCHAR, 'source_origin': source_origin, 'deployment_target': NULL::VARCHAR}), '}') || ',"directories":['""", "true", "true", "mods"),
    ("[1, module_id, 1]", "to_json(directory)", "true", "false", "mdirs"),
    ("[1, module_id, 2]", """'],"decisions":['""", "false", "true", "mods"),
    ("[1, module_id, 3, decision_id]", _SAID, "true", "false", "(SELECT * FROM decs WHERE module_id IS NOT NULL)"),
    ("[1, module_id, 4]", """'],"components":['""", "false", "true", "mods"),
    ("[1, module_id, 5, component_id]", """rtrim(to_json({'id': component_id, 'name': name, 'purpose': purpose, 'confidence': confidence}), '}') || ',"files":['""", "true", "true", "comps"),
    ("[1, c.module_id, 5, component_id, 1]", "to_json({'path': path, 'is_test': is_test})", "true", "false", "cfiles JOIN comps c USING (component_id)"),
    ("[1, module_id, 5, component_id, 2]", """'],"decisions":['""", "false", "true", "comps"),
    ("[1, c.module_id, 5, component_id, 3, decision_id]", _SAID, "true", "false", "decs JOIN comps c USING (component_id)"),
    ("[1, module_id, 5, component_id, 4]", "']}'", "false", "false", "comps"),
    ("[1, module_id, 6]", "']}'", "false", "false", "mods"),
    ("[2]", """'],"module_edges":['""", "false", "true", "(SELECT 1)"),
    ("[3, source_id, target_id]", _EDGE, "true", "false", "medges"),
    ("[4]", """'],"component_edges":['""", "false", "true", "(SELECT 1)"),
    ("[5, source_id, target_id]", _EDGE, "true", "false", "(SELECT *, '{}' AS metadata FROM cedges)"),
    ("[6]", "']}}'", "false", "false", "(SELECT 1)"),
]


@register(
    query(
        "SELECT row_number() OVER (ORDER BY key, text) AS pos, CASE WHEN item AND NOT coalesce(lag(opens) OVER (ORDER BY key, text), false) THEN ',' ELSE '' END || text AS text FROM pieces",
        "mods", "mdirs", "comps", "cfiles", "decs", "medges", "cedges",
        pieces=" UNION ALL ".join(f"SELECT CAST({key} AS BIGINT[]) AS key, CAST({text} AS VARCHAR) AS text, {item} AS item, {opens} AS opens FROM {rows}" for key, text, item, opens, rows in _PIECES),
    )
)
def export_map_flat(spark: SparkSession, sf: str) -> DataFrame:
    """The published map as the ordered fragments of one document."""
    return documents.map_fragments(V.map_tables(spark, sf))


@register(
    query(
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {v}" for n, v in (("modules", "mods"), ("module_directories", "mdirs"), ("components", "comps"), ("component_files", "cfiles"), ("decisions", "decs"), ("module_edges", "medges"), ("component_edges", "cedges"))),
        "mods", "mdirs", "comps", "cfiles", "decs", "medges", "cedges",
    )
)
def import_map_counts(spark: SparkSession, sf: str) -> DataFrame:
    return maptables.table_counts(maptables.import_tables(V.map_tables(spark, sf)))


@register(
    query(
        """SELECT 'module' AS kind, module_id AS a, name AS b FROM mods WHERE module_id <> 2 UNION ALL SELECT 'directory', module_id, directory FROM mdirs WHERE module_id <> 2 UNION ALL SELECT 'component', component_id, name FROM comps WHERE module_id <> 2
        UNION ALL SELECT 'file', component_id, path FROM cfiles WHERE component_id NOT IN (SELECT component_id FROM gone) UNION ALL SELECT 'component edge', source_id, CAST(target_id AS VARCHAR) FROM cedges WHERE source_id NOT IN (SELECT component_id FROM gone) AND target_id NOT IN (SELECT component_id FROM gone)
        UNION ALL SELECT 'module edge', source_id, CAST(target_id AS VARCHAR) FROM medges WHERE source_id <> 2 AND target_id <> 2
        UNION ALL SELECT 'decision', decision_id, text FROM decs WHERE (module_id IS NULL OR module_id <> 2) AND (component_id IS NULL OR component_id NOT IN (SELECT component_id FROM gone))""",
        "mods", "mdirs", "comps", "cfiles", "decs", "medges", "cedges", gone="SELECT component_id FROM comps WHERE module_id = 2",
    )
)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    t = V.map_tables(spark, sf)
    left = maptables.delete_modules(t, t["modules"].where("module_id = 2"))
    shown = [("module", "modules", "module_id", "name"), ("directory", "module_directories", "module_id", "directory"), ("component", "components", "component_id", "name"), ("file", "component_files", "component_id", "path"), ("component edge", "component_edges", "source_id", "target_id"), ("module edge", "module_edges", "source_id", "target_id"), ("decision", "decisions", "decision_id", "text")]
    parts = [left[table].select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).cast("string").alias("b")) for kind, table, a, b in shown]
    return reduce(DataFrame.unionByName, parts)


@register(
    query(
        """SELECT 'component' AS kind, row_number() OVER (ORDER BY module_id, component_id) AS id, module_id + 1 AS owner, name AS text FROM comps
        UNION ALL SELECT 'decision', row_number() OVER (ORDER BY component_id IS NOT NULL, m, c, decision_id), coalesce(m, c), text FROM (SELECT d.decision_id, d.component_id, d.text, d.module_id + 1 AS m, n.c FROM decs d LEFT JOIN (SELECT component_id, row_number() OVER (ORDER BY module_id, component_id) AS c FROM comps) n ON n.component_id = d.component_id)""",
        "comps", "decs",
    )
)
def import_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Components and decisions of an imported map, with their new ids and owners."""
    t = maptables.import_tables(V.map_tables(spark, sf))
    own = t["components"].select(F.lit("component").alias("kind"), F.col("component_id").alias("id"), F.col("module_id").alias("owner"), F.col("name").alias("text"))
    return own.unionByName(t["decisions"].select(F.lit("decision").alias("kind"), F.col("decision_id").alias("id"), F.coalesce("module_id", "component_id").alias("owner"), "text"))


_REL = "SELECT 'NATION_' || (o_custkey % 30) AS source, 'NATION_' || (o_orderkey % 27) AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'uses_data_store' ELSE 'depends_on' END AS edge_type, o_orderkey AS ord FROM orders"


@register(
    query(
        "SELECT source_id, target_id, edge_type, CAST(min(ord) AS BIGINT) AS first_ord FROM (SELECT a.component_id AS source_id, b.component_id AS target_id, edge_type, ord FROM rel JOIN comps a ON a.name = source JOIN comps b ON b.name = target) WHERE source_id <> target_id GROUP BY ALL",
        "comps", rel=_REL,
    )
)
def ingest_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by name: unknown ends and loops go, the first of each key stays."""
    o = V.table(spark, sf, "orders")
    rel = o.select(F.concat(F.lit("NATION_"), (F.col("o_custkey") % 30).cast("string")).alias("source"), F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 27).cast("string")).alias("target"), F.when(F.col("o_orderkey") % 3 == 0, "uses_data_store").otherwise("depends_on").alias("edge_type"), F.col("o_orderkey").alias("ord"))
    ids = V.components(spark, sf).select("name", F.col("component_id").alias("id"))
    edges, _ = maptables.resolve_edge_ids(rel, ids, drop_loops=True)
    return edges.groupBy("source_id", "target_id", "edge_type").agg(F.min("ord").alias("first_ord"))


@register(query("SELECT source_id AS source, target_id AS target, edge_type, weight FROM cedges WHERE edge_type = 'call' AND weight >= 3 AND source_id IN (SELECT component_id FROM comps WHERE module_id <> 1) AND target_id IN (SELECT component_id FROM comps WHERE module_id <> 1)", "cedges", "comps"))
def filter_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = V.component_edges(spark, sf).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "edge_type", "weight")
    return rollup.filter_edges(e, V.components(spark, sf).where("module_id <> 1").select(F.col("component_id").alias("node")), ["call"], 3.0)


_PAIRS = "SELECT DISTINCT least(source_id, target_id) AS x, greatest(source_id, target_id) AS y FROM cedges"


@register(
    query(
        "SELECT module, count(*) FILTER (a = b) AS n_intra, count(*) FILTER (a <> b) AS n_cross FROM (SELECT a, b, a AS module FROM e UNION ALL SELECT a, b, b FROM e WHERE a <> b) GROUP BY 1",
        "cedges", "comps", pr=_PAIRS, e="SELECT m.module_id AS a, n.module_id AS b FROM pr JOIN comps m ON m.component_id = x JOIN comps n ON n.component_id = y",
    )
)
def edge_locality(spark: SparkSession, sf: str) -> DataFrame:
    e = V.component_edges(spark, sf).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    return rollup.edge_locality(e, V.components(spark, sf).select(F.col("component_id").alias("component"), F.col("module_id").alias("module")))


@register(
    query(
        """SELECT least(a, b) AS low, greatest(a, b) AS high, sum(s) AS strength FROM (SELECT m.module_id AS a, n.module_id AS b, 1.0::DOUBLE AS s FROM cedges JOIN comps m ON m.component_id = source_id JOIN comps n ON n.component_id = target_id
        UNION ALL SELECT source_id, target_id, weight FROM medges) WHERE a <> b GROUP BY 1, 2""",
        "cedges", "comps", "medges",
    )
)
def module_pair_strength(spark: SparkSession, sf: str) -> DataFrame:
    e = V.component_edges(spark, sf).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    m = V.module_edges(spark, sf).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "weight")
    return rollup.module_pair_strength(e, V.components(spark, sf).select(F.col("component_id").alias("component"), F.col("module_id").alias("module")), m)


@register(query("SELECT module_id, direction, coalesce(m.name, 'Module #' || other) AS neighbour, edge_type FROM (SELECT source_id AS module_id, target_id AS other, 'depends_on' AS direction, edge_type FROM cedges UNION ALL SELECT target_id, source_id, 'used_by', edge_type FROM cedges) e LEFT JOIN (SELECT component_id AS mid, name FROM comps WHERE component_id <> 3) m ON m.mid = other", "cedges", "comps"))
def module_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as modules, of which one has no name, with the edges of all line items."""
    mods = V.components(spark, sf).where("component_id <> 3").select(F.col("component_id").alias("module_id"), "name")
    return maptables.module_neighbours(mods, V.component_edges(spark, sf))


@register(query("SELECT component_id, name FROM comps WHERE module_id IN (SELECT module_id FROM mods WHERE classification <> 'supporting-asset' AND source_origin = 'in-repo') AND component_id IN (SELECT component_id FROM cfiles WHERE NOT is_test)", "comps", "mods", "cfiles"))
def component_worklist(spark: SparkSession, sf: str) -> DataFrame:
    t = V.map_tables(spark, sf)
    return maptables.component_worklist(t["modules"], t["components"], t["component_files"]).select("component_id", "name")


@register(query("SELECT CASE WHEN trim(coalesce(detail, '')) = '' THEN 'General' ELSE detail END AS \"group\", decision_id, text FROM decs", "decs"))
def group_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return maptables.group_decisions(V.decisions(spark, sf), "detail")


# Text.


@register(query("SELECT decision_id FROM (SELECT decision_id, row_number() OVER (PARTITION BY component_id, category, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY decision_id) AS rn FROM decs WHERE component_id IS NOT NULL) WHERE rn = 1", "decs"))
def dedupe_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return textbatch.dedupe_decisions(V.decisions(spark, sf).where("component_id is not null"), ["decision_id"], ("component_id",)).select("decision_id")


@register(
    query(
        "SELECT x.module_id, category, k AS text_key, count(*) AS components, t.total FROM x JOIN t USING (module_id) GROUP BY x.module_id, category, k, t.total HAVING count(*) / CAST(t.total AS DOUBLE) > 0.5",
        "decs", "comps",
        x="SELECT DISTINCT c.module_id, d.component_id, category, 'rule ' || (decision_id % 97 % 11) AS k FROM decs d JOIN comps c ON c.component_id = d.component_id",
        t="SELECT module_id, count(DISTINCT component_id) AS total FROM x GROUP BY 1 HAVING count(DISTINCT component_id) > 1",
    )
)
def cross_cutting(spark: SparkSession, sf: str) -> DataFrame:
    d = V.decisions(spark, sf).drop("module_id").join(V.components(spark, sf).select("component_id", "module_id"), "component_id")
    d = d.withColumn("text", F.concat(F.lit("RULE \t "), (F.col("decision_id") % 97 % 11).cast("string")))
    return textbatch.cross_cutting(d)


@register(
    query(
        "SELECT source, doc_id, b AS batch_no FROM fold",
        d="SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(length(text) AS BIGINT) END AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents",
        fold="SELECT source, doc_id, rn, s AS total, 0 AS b FROM d WHERE rn = 1 UNION ALL SELECT d.source, d.doc_id, d.rn, CASE WHEN f.total + d.s > 20000 THEN d.s ELSE f.total + d.s END, CASE WHEN f.total + d.s > 20000 THEN f.b + 1 ELSE f.b END FROM fold f JOIN d ON d.source = f.source AND d.rn = f.rn + 1",
    )
)
def batch_by_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document as an empty file."""
    rows = V.table(spark, sf, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.length("text")).alias("size"))
    return textbatch.batch_by_budget(rows, "source", "doc_id", "size", 20000).select("source", "doc_id", "batch_no")


@register(query("SELECT request_id, CASE WHEN text LIKE '%{%' THEN 'json' ELSE 'none' END AS state, CASE WHEN text LIKE '%{%' THEN CAST(regexp_extract(text, '\"k\": ([0-9]+)', 1) AS BIGINT) END AS k FROM resp", "resp"))
def extract_json(spark: SparkSession, sf: str) -> DataFrame:
    ok, bad = textbatch.extract_json(V.responses(spark, sf))
    one = F.coalesce(F.get_json_object("json", "$.k"), F.get_json_object("json", "$[0].k"))
    return ok.select("request_id", F.lit("json").alias("state"), one.cast("long").alias("k")).unionByName(bad.select("request_id", F.lit("none").alias("state"), F.lit(None).cast("long").alias("k")))


@register(
    query(
        "SELECT doc_id, CASE WHEN len(ls) > 20 THEN array_to_string(ls[1:20], chr(10)) || chr(10) || '... (truncated at 20 lines)' ELSE array_to_string(ls, chr(10)) END AS content, tokens FROM ls",
        raw=r"SELECT doc_id, length(text) // 4 AS tokens, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS x FROM documents",
        ls="SELECT doc_id, tokens, CASE WHEN x[-1] = '' THEN x[1:len(x) - 1] ELSE x END AS ls FROM raw",
    )
)
def cap_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), "text")
    return textbatch.with_token_estimate(textbatch.cap_lines(rows, 20), "text").select("doc_id", "content", "tokens")


@register(
    query(
        "SELECT path, coalesce(kinds, '') AS kinds, coalesce(exports, '') AS exports FROM (SELECT node AS path FROM nodes) LEFT JOIN k USING (path) LEFT JOIN e USING (path)",
        "nodes", "occ",
        x="SELECT path, kind, CASE kind WHEN 17 THEN 'Function' WHEN 26 THEN 'Method' WHEN 9 THEN 'Constructor' WHEN 7 THEN 'Class' END AS kn, rtrim(symbol, '.') AS name, doc_ord, occ_ord FROM occ WHERE kind <> 0",
        k="SELECT path, string_agg(kn || '=' || names, ';' ORDER BY kn) AS kinds FROM (SELECT path, kn, string_agg(name, ',' ORDER BY doc_ord, occ_ord) AS names FROM x GROUP BY 1, 2) GROUP BY 1",
        e="SELECT path, string_agg(name, ',' ORDER BY rn) AS exports FROM (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY doc_ord, occ_ord) AS rn FROM x WHERE kind IN (17, 7)) WHERE rn <= 30 GROUP BY 1",
    )
)
def file_metadata(spark: SparkSession, sf: str) -> DataFrame:
    occ = V.occurrences(spark, sf)
    rows = textbatch.file_metadata(occ.select(F.col("relative_path").alias("path")), V.symbols(spark, sf), occ)
    kinds = F.array_join(F.transform(F.array_sort(F.map_keys("symbol_kinds")), lambda k: F.concat(k, F.lit("="), F.array_join(F.col("symbol_kinds")[k], ","))), ";")
    return rows.select("path", kinds.alias("kinds"), F.array_join("exports", ",").alias("exports"))


# Diagnostics.

_COMBINED = "SELECT symbol, path FROM defs UNION ALL SELECT symbol, path FROM listed WHERE symbol NOT IN (SELECT symbol FROM defs)"


@register(
    query(
        """SELECT 'occurrences' AS definitions, (SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) FROM refs WHERE symbol IN (SELECT symbol FROM defs)) AS resolved, (SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) FROM refs WHERE symbol NOT IN (SELECT symbol FROM defs)) AS unresolved,
        (SELECT count(*) FROM (SELECT DISTINCT least(r.path, d.path), greatest(r.path, d.path) FROM refs r JOIN defs d USING (symbol) WHERE r.path <> d.path)) AS file_pairs
        UNION ALL SELECT 'combined', (SELECT CAST(sum(cnt) AS BIGINT) FROM refs), 0, (SELECT count(*) FROM (SELECT DISTINCT least(r.path, d.path), greatest(r.path, d.path) FROM refs r JOIN comb d USING (symbol) WHERE r.path <> d.path))""",
        "refs", "defs", "listed", comb=_COMBINED,
    )
)
def resolution_report(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.resolution_report(V.occurrences(spark, sf), V.symbols(spark, sf))


@register(query("SELECT symbol, CAST(sum(cnt) AS BIGINT) AS cnt FROM refs WHERE symbol NOT IN (SELECT symbol FROM defs) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "refs", "defs"))
def top_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.top_unresolved(V.occurrences(spark, sf))


@register(query("SELECT (SELECT count(*) FROM defs) AS both, CAST(0 AS BIGINT) AS only_occurrences, (SELECT count(*) FROM listed WHERE symbol NOT IN (SELECT symbol FROM defs)) AS only_symbols", "defs", "listed"))
def definition_sources(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.definition_sources(V.occurrences(spark, sf), V.symbols(spark, sf)).select("both", "only_occurrences", "only_symbols")


@register(
    query(
        "SELECT o.path, CAST(coalesce(cross_file, 0) AS BIGINT) AS cross_file, CAST(coalesce(same_file, 0) AS BIGINT) AS same_file, o.n AS occurrences FROM (SELECT path, count(*) AS n FROM occ GROUP BY 1) o LEFT JOIN (SELECT r.path, sum(cnt) FILTER (r.path <> d.path) AS cross_file, sum(cnt) FILTER (r.path = d.path) AS same_file FROM refs r JOIN defs d USING (symbol) GROUP BY 1) x USING (path)",
        "refs", "defs",
    )
)
def file_reference_profile(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.file_reference_profile(V.occurrences(spark, sf), V.symbols(spark, sf)).select("path", "cross_file", "same_file", "occurrences")


@register(
    query(
        "SELECT (SELECT count(*) FROM only_) AS symbols, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS refs, CAST(coalesce(sum(cnt) FILTER (r.path <> o.path), 0) AS BIGINT) AS cross_file FROM refs r JOIN only_ o USING (symbol)",
        "refs", "defs", "listed", only_="SELECT symbol, path FROM listed WHERE symbol NOT IN (SELECT symbol FROM defs)",
    )
)
def missed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return diagnostics.missed_symbols(V.occurrences(spark, sf), V.symbols(spark, sf))


# Constraints.


@register(query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"))
def check_unique(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_unique(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)"))
def check_fk(spark: SparkSession, sf: str) -> DataFrame:
    own = V.table(spark, sf, "customer").where("c_custkey % 3 = 0")
    return checks.check_fk(V.table(spark, sf, "events"), own, "user_id", "c_custkey").select("event_id", "user_id")


@register(query("SELECT decision_id FROM (SELECT decision_id, CASE WHEN decision_id % 13 <> 0 THEN module_id END AS m, component_id AS c FROM decs) WHERE (m IS NULL) = (c IS NULL)", "decs"))
def check_owner(spark: SparkSession, sf: str) -> DataFrame:
    d = V.decisions(spark, sf).withColumn("module_id", F.when(F.col("decision_id") % 13 != 0, F.col("module_id")))
    return checks.check_owner(d).select("decision_id")


@register(query("SELECT component_id, path FROM cfiles WHERE component_id <> 3 UNION ALL SELECT 3, 'fresh_' || r_regionkey FROM region", "cfiles"))
def replace_scope(spark: SparkSession, sf: str) -> DataFrame:
    new = V.table(spark, sf, "region").select(F.lit(3).cast("long").alias("component_id"), F.concat(F.lit("fresh_"), F.col("r_regionkey").cast("string")).alias("path"))
    return readers.replace_scope(V.component_files(spark, sf).select("component_id", "path"), new, ["component_id"])


from depweave.plans import more, rest  # noqa: E402, F401  (register more queries)
