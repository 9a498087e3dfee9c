"""Naming, merging and filling components; the discovery plan over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.paths import ancestors, leaf, parent, stem, with_path_parts
from depweave.operators.spread import spread_join
from depweave.sources.scratch import cut


def _most_common(rows: DataFrame, value: str, blank: str) -> DataFrame:
    """cluster and its most common non-empty value (ties by name); ``blank`` without one."""
    counts = rows.where(F.col(value) != "").groupBy("cluster", value).agg(F.count("*").alias("n"))
    best = counts.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), value))[value].alias(value))
    return rows.select("cluster").distinct().join(best, "cluster", "left").select("cluster", F.coalesce(value, F.lit(blank)).alias(value))


def name_clusters(assign: DataFrame) -> DataFrame:
    """cluster, name (A14): the most common directory name (``root`` without one); repeated names get the most
    common grandparent's (or ``root``) and a ``/`` before them, and what still repeats ``_1``, ``_2``, ... by cluster
    id."""
    rows = with_path_parts(assign.select("cluster", F.col("node").alias("path")))
    names = _most_common(rows, "leaf_dir", "root").join(_most_common(rows, "grandparent_dir", "root"), "cluster")
    repeated = F.count("*").over(Window.partitionBy("leaf_dir")) > 1
    names = names.withColumn("_name", F.when(repeated, F.concat("grandparent_dir", F.lit("/"), "leaf_dir")).otherwise(F.col("leaf_dir")))
    same = Window.partitionBy("_name")
    numbered = F.concat("_name", F.lit("_"), F.row_number().over(same.orderBy("cluster")).cast("string"))
    return names.withColumn("name", F.when(F.count("*").over(same) > 1, numbered).otherwise(F.col("_name"))).select("cluster", "name")


def merge_same_name(components: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of one trimmed name as one (A15): the largest confidence, and the distinct purposes in order
    joined by ``; ``, leaving out a purpose that what came before holds. ``components``: ord, name, purpose,
    confidence; ``files``: name, path."""
    grouped = components.groupBy(F.trim("name").alias("name")).agg(
        F.min("ord").alias("ord"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("ord", F.coalesce("purpose", F.lit("")).alias("p")))).alias("_all")
    )
    joined = F.aggregate("_all", F.lit(""), lambda text, x: F.when((x["p"] == "") | F.contains(text, x["p"]), text).when(text == "", x["p"]).otherwise(F.concat(text, F.lit("; "), x["p"])))
    return grouped.select("ord", "name", joined.alias("purpose"), "confidence"), files.select(F.trim("name").alias("name"), "path").distinct()


def cluster_profile(assign: DataFrame, call_edges: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per cluster the ``top`` directories by files and inner call edges by count."""
    dirs = assign.select("cluster", parent("node").alias("dir")).groupBy("cluster", "dir").agg(F.count("*").alias("n"))
    own = assign.select("node", "cluster")
    inner = call_edges.join(own.withColumnRenamed("node", "src"), "src").join(own.select(F.col("node").alias("dst"), F.col("cluster").alias("_c")), "dst").where("cluster = _c").select("cluster", "src", "dst", "cnt")

    def first(rows: DataFrame, *order: Column | str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("rank") <= top)

    return first(dirs, F.desc("n"), "dir"), first(inner, F.desc("cnt"), "src", "dst")


def reconcile_misplaced(component_files: DataFrame, suggestions: DataFrame) -> DataFrame:
    """component, path after each file moves to the component of its most confident suggestion, if that exists
    (G8). ``suggestions``: path, target, confidence; ties go to the smaller name. Components that lose all
    files are gone with them."""
    best = suggestions.groupBy("path").agg(F.min_by("target", F.struct((-F.col("confidence")).alias("c"), "target")).alias("target"))
    best = best.join(component_files.select(F.col("component").alias("target")).distinct(), "target", "left_semi")
    return component_files.join(best, "path", "left").select(F.coalesce("target", "component").alias("component"), "path")


def name_candidates(path: str = "path") -> Column:
    """What a test file may be named after, in lower case: of ``test_a_b`` the subject ``a_b``, and if it has a ``_`` its
    first part ``a`` and the path ``a/b``; and the name of its directory unless that only says test."""
    name = stem(path)
    subject = F.when(F.startswith(name, F.lit("test_")), F.lower(F.substring(name, 6, 1 << 20))).otherwise("")
    parted = F.instr(subject, "_") > 0
    folder = F.when(parent(path) == ".", "").otherwise(leaf(parent(path)))
    folder = F.when(folder.isin("test", "tests", "__tests__", "spec"), "").otherwise(F.lower(folder))
    every = F.array(subject, F.when(parted, F.substring_index(subject, "_", 1)).otherwise(""), F.when(parted, F.translate(subject, "_", "/")).otherwise(""), folder)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) > 0)))


def _grams(text: str, size: Column) -> Column:
    """Distinct parts of that many characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, size)))


def holders(rows: DataFrame, names: DataFrame, size: int = 3) -> DataFrame:
    """``rows`` with each ``name`` (distinct texts) that their ``text`` contains.

    An inverted index of q-grams: a text gives its distinct parts of ``size`` characters, and of fewer where names are so
    short. A name is looked up by the one of its parts that the fewest texts have, and what is found is checked. So a
    text gives as many rows as it has characters at most, whatever the names; parts that no name needs are dropped first,
    and a part that very many texts have is dealt over tasks."""
    names = cut(names.where("name <> ''").select("name", F.least(F.length("name"), F.lit(size)).alias("q")), "names")
    sizes = sorted(r.q for r in names.select("q").distinct().collect())  # ``size`` at most
    if not sizes:
        return rows.withColumn("name", F.lit(None).cast("string")).where(F.lit(False))
    own = names.select("name", F.explode(_grams("name", F.col("q"))).alias("gram"))
    wanted = own.select("gram").distinct()
    texts = cut(rows.select("text").distinct(), "texts")
    parts = texts.select("text", F.explode(F.array_distinct(F.flatten(F.array(*(_grams("text", F.lit(q)) for q in sizes))))).alias("gram"))
    parts = cut(parts.join(wanted, "gram", "left_semi"), "grams")
    counts = parts.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram").groupBy("name").agg(F.count("*").alias("found"), F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    # A name one of whose parts no text has is in none.
    rarest = rarest.join(own.groupBy("name").agg(F.count("*").alias("parts")), "name").where("found = parts").select("name", "gram")
    found = spread_join(parts, rarest, "gram").where(F.contains("text", "name")).select("text", "name")
    return spread_join(cut(found, "holders"), rows, "text")


def assign_tests(tests: DataFrame, call_edges: DataFrame, component_files: DataFrame) -> DataFrame:
    """path, component, how of each test file (J8): the component that most of its calls go to (``calls``),
    else the one with most source files whose lower-cased path contains one of the test's names (``name``), else
    ``unassigned``. Ties go to the smaller component name.

    Containment is looked up by q-grams (``holders``). Tests with the same names are one row until the end.
    """
    tests = tests.select("path").distinct()
    own = component_files.select("component", "path")
    pairs = call_edges.select("cnt", F.explode(F.array(F.struct(F.col("src").alias("path"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("path"), F.col("src").alias("other")))).alias("e")).select("e.path", "e.other", "cnt")
    called = pairs.join(tests, "path", "left_semi").join(own.withColumnRenamed("path", "other"), "other").groupBy("path", "component").agg(F.sum("cnt").alias("k"))
    by_calls = called.groupBy("path").agg(F.min_by("component", F.struct((-F.col("k")).alias("k"), "component")).alias("component"))

    left = cut(tests.join(by_calls, "path", "left_anti").select("path", name_candidates().alias("names")), "tests")
    names = left.select(F.explode("names").alias("name")).distinct()
    held = holders(own.select("component", F.col("path").alias("source"), F.lower("path").alias("text")), names).select("component", "source", "name")
    sets = left.select("names").distinct()
    hit = sets.select("names", F.explode("names").alias("name")).join(held, "name").select("names", "component", "source").distinct()
    counts = hit.groupBy("names", "component").agg(F.count("*").alias("k"))
    best = counts.groupBy("names").agg(F.min_by("component", F.struct((-F.col("k")).alias("k"), "component")).alias("component"))
    by_name = left.join(best, "names").select("path", "component")
    found = by_calls.withColumn("how", F.lit("calls")).unionByName(by_name.withColumn("how", F.lit("name")))
    return tests.join(found, "path", "left").select("path", F.coalesce("component", F.lit("unassigned")).alias("component"), F.coalesce("how", F.lit("unassigned")).alias("how"))


def plain_name(name: Column | str) -> Column:
    """Lower case without ``_`` and ``-``."""
    return F.translate(F.lower(F.col(name) if isinstance(name, str) else name), "_-", "")


def assign_new_tests(tests: DataFrame, sources: DataFrame, components: DataFrame) -> DataFrame:
    """path, component of new test files (J9): that of the first assigned new source (by path) whose directory is the
    test's or above it, else the component whose plain name is the directory's. A source at the root is above
    nothing, it only serves tests at the root. ``sources``: path, component; ``components``: component and, where it
    isn't the component itself, name. With module_id in ``tests`` and ``components`` names count within a module."""
    by = [c for c in ("module_id",) if c in tests.columns and c in components.columns]
    up = F.when(parent("path") == ".", F.array(F.lit("."))).otherwise(ancestors(parent("path")))
    near = tests.select("path", F.explode(up).alias("dir"))
    here = sources.groupBy(parent("path").alias("dir")).agg(F.min(F.struct(F.col("path").alias("first"), "component")).alias("s"))
    by_dir = near.join(here, "dir").groupBy("path").agg(F.min("s")["component"].alias("component"))
    name = "name" if "name" in components.columns else "component"
    named = components.select(*by, plain_name(name).alias("key"), "component").groupBy(*by, "key").agg(F.min("component").alias("named"))
    rows = tests.select(*by, "path").distinct().join(by_dir, "path", "left").withColumn("key", F.when(parent("path") != ".", plain_name(leaf(parent("path")))))
    return rows.join(named, [*by, "key"], "left").select(*by, "path", F.coalesce("component", "named").alias("component")).where("component is not null")


def apply_split_responses(clusters: DataFrame, parts: DataFrame) -> DataFrame:
    """cluster, name, path from proposed sub-components (J20): a file keeps its first proposed part if it is a
    file of that cluster; files that none names go to the first part. ``clusters``: cluster, path; ``parts``:
    cluster, part_ord, name, path (null for an empty part). Parts without files drop out."""
    valid = parts.where("path is not null").join(clusters, ["cluster", "path"], "left_semi").groupBy("cluster", "path").agg(F.min_by("name", "part_ord").alias("name"))
    first = parts.groupBy("cluster").agg(F.min_by("name", "part_ord").alias("name"))
    rest = clusters.join(valid, ["cluster", "path"], "left_anti").join(first, "cluster")
    return valid.select("cluster", "name", "path").unionByName(rest.select("cluster", "name", "path"))


def components_from_responses(clusters: DataFrame, responses: DataFrame) -> DataFrame:
    """cluster, ord, name, purpose, confidence of each cluster's components.

    ``clusters``: cluster, name (its own); ``responses``: cluster, ok, should_split, confidence,
    primary_responsibility, and for each proposed part a row with part_ord, name, purpose (one row with a null
    part_ord without any). A good response that says so and has several parts splits the cluster, with confidence
    0.7 where none is given. Any other names the whole after its first part; without a part it keeps the cluster's
    name, with confidence 0.5 where none is given. A blank purpose is the primary responsibility. Without a good
    response the confidence is 0.3."""
    state = responses.groupBy("cluster").agg(
        F.max("ok").alias("ok"), F.max("should_split").alias("should_split"), F.max("confidence").alias("confidence"), F.max("primary_responsibility").alias("primary"), F.count("part_ord").alias("parts"), F.min("part_ord").alias("first")
    )
    base = clusters.select("cluster", F.col("name").alias("own")).join(state, "cluster", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    splits = F.col("ok") & F.coalesce("should_split", F.lit(False)) & (F.col("parts") > 1)
    parts = responses.where("ok and part_ord is not null").select("cluster", "part_ord", "name", "purpose")
    rows = base.join(parts, "cluster", "left").where(F.col("part_ord").isNull() | splits | (F.col("part_ord") == F.col("first")))
    has = F.col("ok") & F.col("part_ord").isNotNull()
    whole = F.coalesce("primary", F.lit(""))
    return rows.select(
        "cluster",
        F.when(splits, F.col("part_ord")).otherwise(0).alias("ord"),
        F.when(has, F.coalesce("name", "own")).otherwise(F.col("own")).alias("name"),
        F.when(~F.col("ok"), "").when(splits, F.coalesce("purpose", F.lit(""))).otherwise(F.coalesce("purpose", whole)).alias("purpose"),
        F.when(~F.col("ok"), 0.3).otherwise(F.coalesce("confidence", F.when(has, 0.7).otherwise(0.5))).alias("confidence"),
    )


def low_confidence(components: DataFrame, below: float = 0.5) -> DataFrame:
    """Components under the confidence; a missing or zero one counts as 1."""
    return components.where(F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0)) < below)


RESPONSES = "cluster int, ok boolean, should_split boolean, confidence double, primary_responsibility string, part_ord int, name string, purpose string, files array<string>"


def discover(
    occ: DataFrame, symbols: DataFrame, relationships: DataFrame | None = None, responses: DataFrame | None = None, suggestions: DataFrame | None = None,
    labels: DataFrame | None = None, contents: DataFrame | None = None, target: int | None = None,
) -> dict[str, DataFrame]:
    """Components of one code base, end to end.

    Edges -> source files -> partitions -> a weighted graph for each partition (noise gate, affinity, hubs) ->
    communities about each partition's target count -> merged, redistributed and named clusters -> components by the
    response table -> equal names merged -> misplaced files moved -> test files -> component edges and their labels.
    All partitions advance in the same jobs. ``responses`` as in ``RESPONSES``, ``suggestions``: path, target,
    confidence; ``labels``: source, target, edge_type, ord, label. Without responses each cluster is a component of
    confidence 0.3. Returns edges, clusters (cluster, name, path), metadata, directories and calls (what requests
    are made of), components, component_files (component, path, is_test), component_edges.
    """
    from depweave.functions.paths import is_test
    from depweave.operators import cluster, resolution, rollup, textbatch, weights

    edges = cut(resolution.merge_indexes([resolution.file_edges(occ, symbols, relationships)]), "edges")
    files = cut(occ.select(F.col("relative_path").alias("node")).distinct(), "files")
    source = files.where(~is_test("node"))
    target = target or min(25, max(3, source.count() // 1000))
    part = cut(cluster.partition_nodes(source, target=target), "partitions")
    weighted = weights.combine_weights(edges, source)
    nodes, graph = weights.add_directory_affinity(source, weights.drop_noise(weighted, part))
    graph = cut(graph, "graph")
    # A directory's virtual node goes where its files are.
    pairs = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("file")), F.struct(F.col("dst").alias("node"), F.col("src").alias("file"))))
    virtual = graph.select(pairs.alias("p")).select("p.*").join(nodes.where("is_virtual").select("node"), "node", "left_semi")
    virtual = virtual.join(part.withColumnRenamed("node", "file"), "file").groupBy("node").agg(F.min("partition").alias("partition"))
    every = cut(part.unionByName(virtual), "partitions")
    graph = weights.dampen_hubs(graph, nodes, partition=every)
    found = cluster.communities_targeted(graph, nodes, cluster.partition_targets(part, target), every)
    assign = cut(cluster.globalise_ids(cut(weights.strip_virtual(found, nodes), "found")).select("node", "cluster"), "clusters")
    calls = edges.where("edge_type = 'call'").select("src", "dst", "cnt")
    assign = cut(cluster.merge_small_clusters(assign, target), "merged")
    assign = cut(cluster.redistribute(assign, calls), "clusters")
    named = cut(name_clusters(assign), "names")
    directories, inner = cluster_profile(assign, calls)

    rows = assign.select("cluster", F.col("node").alias("path"))
    if responses is None:
        responses = occ.sparkSession.createDataFrame([], RESPONSES)
    answered = components_from_responses(named, responses)
    split = answered.groupBy("cluster").count().where("count > 1").select("cluster")
    parts = responses.join(split, "cluster", "left_semi").select("cluster", "part_ord", "name", F.explode_outer("files").alias("path"))
    whole = rows.join(split, "cluster", "left_anti").join(answered.select("cluster", "name"), "cluster").select("name", "path")
    owned = whole.unionByName(apply_split_responses(rows.join(split, "cluster", "left_semi"), parts).select("name", "path"))
    merged, owned = merge_same_name(answered.select(F.struct("cluster", "ord").alias("ord"), "name", "purpose", "confidence"), owned)
    owned = owned.select(F.col("name").alias("component"), "path")
    owned = cut(owned if suggestions is None else reconcile_misplaced(owned, suggestions), "owned")
    merged = merged.drop("ord").join(owned.select(F.col("component").alias("name")).distinct(), "name", "left_semi")
    tests = assign_tests(files.where(is_test("node")).select(F.col("node").alias("path")), calls, owned)
    component_edges = rollup.rollup_edges(edges, owned)
    if labels is not None:
        component_edges = rollup.apply_edge_labels(component_edges, labels)
    return {
        "edges": edges,
        "clusters": named.join(rows, "cluster"),
        "metadata": textbatch.file_metadata(source.select(F.col("node").alias("path")), symbols, occ, contents),
        "directories": directories,
        "calls": inner,
        "components": merged,
        "component_files": owned.withColumn("is_test", F.lit(False)).unionByName(tests.select("component", "path", F.lit(True).alias("is_test"))),
        "component_edges": component_edges,
    }
