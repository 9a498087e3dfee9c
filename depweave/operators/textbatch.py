"""Text batches, request rows, response rows, and documents in Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.paths import BINARY_EXTENSIONS, extension, parent
from depweave.functions.names import spare
from depweave.functions.symbols import is_definition, is_local, kind_name, symbol_module, symbol_name
from depweave.operators.cluster import connected_components
from depweave.operators.similar import similar_sets
from depweave.sources.scratch import cut, numbered

#: Categories that component decisions may have: fixed values.
CATEGORIES = ["api_contracts", "patterns", "libraries", "boundaries", "error_handling", "data_flow"]


def norm_text(col: Column | str) -> Column:
    """Lower case, white space drawn together."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def with_token_estimate(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    """A quarter of the length, rounded down."""
    return df.withColumn(out, F.floor(F.length(col) / 4).cast("long"))


def with_doc_filename(modules: DataFrame) -> DataFrame:
    """Safe, distinct file names (P13): letters, digits, ``_``, ``-``; an empty one is ``Module_<id>``, repeated
    ones get ``_<id>`` from the second on."""
    plain = F.regexp_replace(F.trim(F.regexp_replace("name", r"[^a-zA-Z0-9_\- ]", "")), r"\s+", "_")
    rows = modules.withColumn("_f", F.when(plain == "", F.concat(F.lit("Module_"), F.col("module_id").cast("string"))).otherwise(plain))
    again = F.row_number().over(Window.partitionBy("_f").orderBy("module_id")) > 1
    return rows.withColumn("file_name", F.when(again, F.concat("_f", F.lit("_"), F.col("module_id").cast("string"))).otherwise(F.col("_f"))).drop("_f")


#: What ends a line: fixed values.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def cap_lines(files: DataFrame, n: int = 1500, content: str = "content", path: str = "path") -> DataFrame:
    """Files without binary ones (F1). A text becomes its lines, joined by line feeds; an end of line at the end begins
    no new one. Of more than ``n`` lines the first ``n`` stay, with a line that says so."""
    lines = F.split(content, LINE_ENDS)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    cut = F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit(f"\n... (truncated at {n} lines)"))
    return files.where(~extension(path).isin(BINARY_EXTENSIONS)).withColumn(content, F.when(F.size(lines) > n, cut).otherwise(F.array_join(lines, "\n")))


def _first_breaks(sizes: list[int], budget: int) -> tuple[int, int, list[int], list[int], list[int]]:
    """Of a range that holds one group only: batches begun after the first and the size of the open one if a batch
    begins with the range; and where one goes on into it: the sums with each row at which the next batch may begin,
    and for each the new batches to the end and the size of the open one."""
    n, sums = len(sizes), [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    more, rest, after, k = [0] * n, [0] * n, [n] * n, 0
    # Where the batch that begins at row i ends.
    for i in range(n):
        k = max(k, i + 1)
        while k < n and sums[k + 1] - sums[i] <= budget:
            k += 1
        after[i] = k
    for i in range(n - 1, -1, -1):
        more[i], rest[i] = (0, sums[n] - sums[i]) if after[i] == n else (1 + more[after[i]], rest[after[i]])
    rows: list[int] = []
    for j in range(n):
        if not rows or sums[j + 1] > sums[rows[-1] + 1]:  # of equal sums the first tells all
            rows.append(j)
        if sums[j + 1] > budget:
            break
    return more[0], rest[0], [sums[j + 1] for j in rows], [1 + more[j] for j in rows], [rest[j] for j in rows]


def batch_by_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """``df`` with batch_no (F2): within a group in order, a new batch begins where the current one has a row and
    would exceed the budget. Groups may be of any size: sorted ranges are walked at once, and only the open size
    and the batch number go from range to range. Rows keep their number, whatever repeats; null groups are a group.
    """
    keys = [group, order, size]
    (at_name,) = spare(df.columns, "range")
    # Kept on the executors' disks as they are dealt, so that both passes see the same ranges without another shuffle; a
    # lost one is read again from the shuffle, in the same bounds.
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at_name, F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now = None, None

        def row() -> pa.RecordBatch:
            at, first, sizes, last, total, no = now
            whole = last is sizes
            no, total, upto, breaks, rest = _first_breaks(sizes, budget) if whole else (no, total, [], [], [])
            values = [at, first, first if whole else last[0], whole, sum(sizes), total, no, upto, breaks, rest]
            types = [pa.int32(), kind, kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            names = ["at", "first", "last", "whole", "sum", "total", "no", "upto", "breaks", "rest"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            kind = batch.column(1).type
            for at, g, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = s or 0
                if now is None or now[0] != at:
                    if now is not None:
                        yield row()
                    sizes: list[int] = []
                    now = [at, g, sizes, sizes, 0, 0]
                if now[3] is now[2] and g == now[1]:
                    now[2].append(s)
                elif now[3] is now[2] or g != now[3][0]:
                    now[3:] = [(g,), s, 0]
                elif now[4] + s > budget:
                    now[4:] = [s, now[5] + 1]
                else:
                    now[4] += s
        if now is not None:
            yield row()

    kind = df.schema[group].dataType.simpleString()
    lists = ", ".join(f"{c} array<bigint>" for c in ("upto", "breaks", "rest"))
    found = rows.select(at_name, group, F.col(size).cast("long").alias(size)).mapInArrow(ends, f"at int, first {kind}, last {kind}, whole boolean, sum bigint, total bigint, no bigint, {lists}")
    # Of each range: whether it goes on with a group, and the open size and batch number there.
    carried: dict[int, tuple[bool, int, int]] = {}
    last, total, no = None, 0, 0
    for r in cut(found, "batch-ends").orderBy("at").toLocalIterator():
        goes_on = bool(carried) and r["first"] == last
        carried[r["at"]] = (goes_on, total, no) if goes_on else (False, 0, 0)
        if not r["whole"] or not goes_on:
            total, no = r["total"], r["no"]
        else:
            hit = next((i for i, u in enumerate(r["upto"]) if total + u > budget), None)
            total, no = (total + r["sum"], no) if hit is None else (r["rest"][hit], no + r["breaks"][hit])
        last = r["last"]
    at_group, at_size, at_range = (rows.columns.index(c) for c in (group, size, at_name))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, has, total, no = None, None, False, 0, 0
        for batch in batches:
            out = []
            for at, g, s in zip(*(batch.column(i).to_pylist() for i in (at_range, at_group, at_size)), strict=True):
                s = int(s or 0)
                if at != now:
                    now, own, (has, total, no) = at, g, carried[at]
                elif g != own:
                    own, has, total, no = g, False, 0, 0
                if has and total + s > budget:
                    total, no = s, no + 1
                else:
                    total += s
                has = True
                out.append(no)
            kept = [i for i in range(batch.num_columns) if i != at_range]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out, pa.int32())], names=[*(batch.schema.names[i] for i in kept), "batch_no"])

    return rows.mapInArrow(number, rows.drop(at_name).withColumn("batch_no", F.lit(0)).schema)


def _joined(items: Column, order: str, sep: str) -> Column:
    """Texts of a group in order: ``items`` is a struct (order.., text)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["text"]), sep)


def render_batches(batches: DataFrame, group: str, path: str = "path", content: str = "content") -> DataFrame:
    """group, batch_no, body: files with a header line each, in path order."""
    text = F.concat(F.lit("--- file: "), path, F.lit(" ---\n"), content)
    return batches.groupBy(group, "batch_no").agg(_joined(F.struct(F.col(path).alias("o"), text.alias("text")), "o", "\n\n").alias("body"))


def decision_requests(batches: DataFrame, group: str, template: str) -> DataFrame:
    """A request a batch (F5); the template's ``{files}`` takes the rendered files."""
    head, _, tail = template.partition("{files}")
    return render_batches(batches, group).select(group, "batch_no", F.concat(F.lit(head), "body", F.lit(tail)).alias("request"))


def cluster_requests(assign: DataFrame, metadata: DataFrame, dirs: DataFrame, edges: DataFrame, most_tokens: int = 8000, few: int = 30) -> DataFrame:
    """cluster, request (F4): a line a file with its first exports and the start of its docstring, then top
    directories and call edges. Requests over ``most_tokens`` keep only the first ``few`` files."""
    note = F.substring(F.regexp_replace(F.coalesce("docstring", F.lit("")), "\n", " "), 1, 150)
    exports = F.array_join(F.slice(F.coalesce("exports", F.array().cast("array<string>")), 1, 5), ", ")
    line = F.concat(F.lit("- "), "path", F.when(exports != "", F.concat(F.lit(" ["), exports, F.lit("]"))).otherwise(""), F.when(note != "", F.concat(F.lit(": "), note)).otherwise(""))
    files = assign.select("cluster", F.col("node").alias("path")).join(metadata, "path", "left").withColumn("text", line)
    order = Window.partitionBy("cluster").orderBy("path")
    files = files.withColumn("rn", F.row_number().over(order))
    item = F.struct(F.col("path").alias("o"), "text")
    lines = files.groupBy("cluster").agg(_joined(item, "o", "\n").alias("full"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= few, item))), lambda x: x["text"]), "\n").alias("short"), F.count("*").alias("n"))
    d = dirs.groupBy("cluster").agg(_joined(F.struct(F.col("rank").alias("o"), F.format_string("%s (%d)", "dir", "n").alias("text")), "o", ", ").alias("dirs"))
    e = edges.groupBy("cluster").agg(_joined(F.struct(F.col("rank").alias("o"), F.format_string("%s -> %s (%d)", "src", "dst", "cnt").alias("text")), "o", "\n").alias("calls"))
    rows = lines.join(d, "cluster", "left").join(e, "cluster", "left")
    tail = F.concat(F.lit("\nDirectories: "), F.coalesce("dirs", F.lit("")), F.lit("\nCalls:\n"), F.coalesce("calls", F.lit("")))
    whole = F.concat("full", tail)
    cut = F.concat("short", F.format_string("\n... and %d more files", F.col("n") - few), tail)
    return rows.select("cluster", F.when((F.floor(F.length(whole) / 4) > most_tokens) & (F.col("n") > few), cut).otherwise(whole).alias("request"))


def elevation_requests(decisions: DataFrame, components: DataFrame) -> DataFrame:
    """module_id, request (F6): component decisions as ``[id] (category) text``, for modules in which more than one
    component has any."""
    rows = decisions.drop("module_id").join(components.select("component_id", "module_id", "name"), "component_id")
    line = F.format_string("[%d] (%s) %s", "decision_id", "category", "text")
    per = rows.groupBy("module_id", "component_id", "name").agg(_joined(F.struct(F.col("decision_id").alias("o"), line.alias("text")), "o", "\n").alias("body"))
    block = F.concat(F.lit("## "), "name", F.lit("\n"), "body")
    out = per.groupBy("module_id").agg(F.count("*").alias("k"), _joined(F.struct("name", "component_id", block.alias("text")), "name", "\n\n").alias("request"))
    return out.where("k > 1").select("module_id", "request")


def validation_requests(components: DataFrame, files: DataFrame, decisions: DataFrame) -> DataFrame:
    """component_id, pipeline and human decisions apart, files (F8); components without decisions or without
    files are left out. ``decisions``: component_id, decision_id, category, text, source."""
    line = F.format_string("[%d] (%s) %s", "decision_id", "category", "text")
    item = F.struct(F.col("decision_id").alias("o"), line.alias("text"))
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda x: x["text"]), "\n")
    human = F.col("source") == "human"
    d = decisions.groupBy("component_id").agg(text(~human).alias("pipeline_decisions"), text(human).alias("human_decisions"))
    f = files.where("not is_test").groupBy("component_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return components.select("component_id", "name").join(d, "component_id").join(f, "component_id")


def classification_requests(new_files: DataFrame, components: DataFrame, n_lines: int = 1500) -> DataFrame:
    """module_id, path, request (F9): the file's content with the module's components."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("purpose", F.lit("")))
    known = components.groupBy("module_id").agg(_joined(F.struct(F.col("name").alias("o"), line.alias("text")), "o", "\n").alias("known"))
    rows = cap_lines(new_files, n_lines).join(known, "module_id", "left")
    return rows.select("module_id", "path", F.concat(F.coalesce("known", F.lit("(none)")), F.lit("\n\n--- file: "), "path", F.lit(" ---\n"), "content").alias("request"))


def ticket_lines(net: DataFrame) -> DataFrame:
    """n, part, line: the net changes by lines (F10), numbered in entity order: what happened to which entity of which
    component and module, and category and text of what was and of what is now, where a value is a JSON object.
    ``net``: entity_type, entity_id, action, old_value, new_value and optionally component_name, module_name."""

    def name(c: str, what: str) -> Column:
        known = F.nullif(F.col(c), F.lit("")) if c in net.columns else F.lit(None).cast("string")
        return F.coalesce(known, F.lit(f"unknown {what}"))

    def shown(value: str, when: str) -> Column:
        field = lambda f: F.coalesce(F.get_json_object(value, f"$.{f}"), F.lit(""))
        is_object = F.ltrim(value).startswith("{") & F.try_parse_json(value).isNotNull() & (F.regexp_replace(value, r"\s", "") != "{}")
        return F.when(is_object, F.concat(F.lit(f"   {when}: ["), field("category"), F.lit("] "), field("text")))

    rows = numbered(net, ["entity_type", "entity_id"], "n")
    head = F.concat(F.col("n").cast("string"), F.lit(". "), F.upper("action"), F.lit(" "), "entity_type", F.lit(' on component "'), name("component_name", "component"), F.lit('" (module: '), name("module_name", "module"), F.lit(")"))
    lines = F.array(head, shown("old_value", "Was"), shown("new_value", "Now"))
    return rows.select("n", F.posexplode(lines).alias("part", "line")).where("line is not null")


def ticket_request(net: DataFrame) -> DataFrame:
    """One row request: the lines of ``ticket_lines`` with an empty one after each change, for as many changes as fit one
    request (F10)."""
    lines = ticket_lines(net)
    last = lines.groupBy("n").agg((F.max("part") + 1).alias("part")).withColumn("line", F.lit(""))
    return lines.unionByName(last).agg(_joined(F.struct("n", "part", F.col("line").alias("text")), "n", "\n").alias("request"))


def extracted_json(col: str) -> Column:
    """The JSON of a response as text in one spelling, null without any (F11): the whole text, the first ``json``
    block, the first fenced block after its first line, or from the first brace to the last."""
    text = F.col(col)
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), text.substr(first, last - first + 1))
    candidates = [F.trim(text), F.trim(F.regexp_extract(text, r"(?s)```json\s*\n(.*?)```", 1)), F.trim(F.regexp_extract(text, r"(?s)```[^\n]*\n(.*?)```", 1)), braces]
    return F.coalesce(*(F.to_json(F.try_parse_json(F.when(c.rlike(r"(?s)^\s*[\[{]"), c))) for c in candidates))


def extract_json(df: DataFrame, col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``json``, rows without any)."""
    rows = df.withColumn("json", extracted_json(col))
    return rows.where("json is not null"), rows.where("json is null").drop("json")


def validate_decisions(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Rows with an allowed category and a text; text and detail trimmed, a blank detail null."""
    rows = df.where(F.col("category").isin(categories or CATEGORIES) & (F.trim("text") != ""))
    return rows.withColumn("text", F.trim("text")).withColumn("detail", F.nullif(F.trim("detail"), F.lit("")))


def dedupe_decisions(df: DataFrame, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The first of each (category, normalised text) in order (A29); ``by``: within what."""
    key = Window.partitionBy(*by, "category", norm_text("text")).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(key)).where("_rn = 1").drop("_rn")


def near_texts(texts: DataFrame, similar: float = 0.8) -> DataFrame:
    """category, text_key, like: of distinct normalised texts, the smallest one that near-equal texts of the same
    category lead to. Near-equal: word sets of Jaccard similarity ``similar`` or more (``similar_sets``, exact)."""
    rows = texts.select("category", "text_key").distinct().where("text_key <> ''")
    sets = rows.select(F.coalesce("category", F.lit("")).alias("part"), F.col("text_key").alias("id"), F.split("text_key", " ").alias("items"))
    pairs = similar_sets(sets, similar)
    # A node is a category and a text; the separator sorts before all that texts hold.
    node = lambda c: F.concat_ws("\u0001", "part", c)
    found = connected_components(pairs.select(node("a").alias("src"), node("b").alias("dst")))
    text = lambda c: F.substring_index(c, "\u0001", -1)
    return found.select(F.substring_index("node", "\u0001", 1).alias("category"), text("node").alias("text_key"), text("component").alias("like"))


def cross_cutting(decisions: DataFrame, share: float = 0.5, similar: float | None = None) -> DataFrame:
    """module_id, category, text_key, components (A28): statements in more than ``share`` of a module's components
    that have decisions, where there are at least two such. ``decisions``: module_id, component_id, category, text.
    With ``similar`` near-equal statements count as one, named by the smallest text (``near_texts``)."""
    rows = decisions.select("module_id", "component_id", "category", norm_text("text").alias("text_key")).distinct()
    if similar is not None:
        like = near_texts(rows, similar)
        rows = rows.join(like, ["category", "text_key"], "left").withColumn("text_key", F.coalesce("like", "text_key")).drop("like").distinct()
    total = rows.groupBy("module_id").agg(F.countDistinct("component_id").alias("total")).where("total > 1")
    held = rows.groupBy("module_id", "category", "text_key").agg(F.count("*").alias("components"))
    return held.join(total, "module_id").where(F.col("components") / F.col("total") > share).select("module_id", "category", "text_key", "components", "total")


def usage_stats(ledger: DataFrame) -> DataFrame:
    """One row: input, output and total tokens."""
    sums = ledger.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")))
    return sums.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def file_metadata(files: DataFrame, symbols: DataFrame, occ: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """path, directory, symbol_kinds (map of names), exports, imports, docstring, lines_of_code of every file of
    ``files`` (M1, J14). ``contents``: path, content."""
    named = symbols.where(~is_local()).withColumn("kind_name", kind_name()).where("kind_name is not null")
    named = named.select(F.col("relative_path").alias("path"), "kind_name", F.struct("doc_ord", "sym_ord", symbol_name().alias("name")).alias("x"))
    per = named.groupBy("path", "kind_name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))
    kinds = per.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind_name", "names")))).alias("symbol_kinds"))
    public = named.where(F.col("kind_name").isin("Class", "Function", "Interface", "Trait")).groupBy("path").agg(F.slice(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]), 1, 30).alias("exports"))
    used = occ.where(~is_local() & ~is_definition()).select(F.col("relative_path").alias("path"), symbol_module().alias("m")).where("m is not null")
    imports = used.groupBy("path").agg(F.slice(F.array_sort(F.collect_set("m")), 1, 20).alias("imports"))
    rows = files.select("path").distinct()
    for part in (kinds, public, imports):
        rows = rows.join(part, "path", "left")
    if contents is None:
        rows = rows.withColumn("content", F.lit(None).cast("string"))
    else:
        rows = rows.join(contents.select("path", "content"), "path", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "path", parent("path").alias("directory"), F.coalesce("symbol_kinds", F.create_map().cast("map<string,array<string>>")).alias("symbol_kinds"), F.coalesce("exports", none).alias("exports"),
        F.coalesce("imports", none).alias("imports"), docstring().alias("docstring"), line_count().alias("lines_of_code"),
    )


def docstring(content: str = "content", path: str = "path", lines: int = 50, most: int = 500) -> Column:
    """The module docstring of a ``.py`` file (M2): triple-quoted at the very start, within the first ``lines``."""
    head = F.array_join(F.slice(F.split(content, "\n"), 1, lines), "\n")
    found = F.trim(F.regexp_extract(head, r"(?s)\A\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')", 1))
    other = F.trim(F.regexp_extract(head, r"(?s)\A\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')", 2))
    text = F.when(found != "", found).otherwise(other)
    text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return F.when(F.endswith(F.col(path), F.lit(".py")), F.coalesce(text, F.lit(""))).otherwise("")


def line_count(content: str = "content") -> Column:
    """Lines of the text; an end of line at the end begins no new one (M3)."""
    n = F.size(F.split(content, "\n")) - F.when(F.endswith(F.col(content), F.lit("\n")), 1).otherwise(0)
    return F.when(F.coalesce(F.col(content), F.lit("")) == "", 0).otherwise(n)


def render_decisions(decisions: DataFrame, by: str, heading: str = "####") -> DataFrame:
    """``by``, body: decisions as Markdown by category, blank ones ``General`` (F14), in id order."""
    category = F.when(F.trim(F.coalesce("category", F.lit(""))) == "", "General").otherwise(F.col("category"))
    quoted = F.array_join(F.transform(F.split("detail", "\n"), lambda x: F.concat(F.lit("  > "), x)), "\n")
    line = F.concat(F.lit("- "), "text", F.lit(" *(source: "), F.coalesce("source", F.lit("unknown")), F.lit(")*"), F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit("\n"), quoted)).otherwise(""), F.lit("\n"))
    per = decisions.groupBy(by, category.alias("category")).agg(F.min("decision_id").alias("first"), _joined(F.struct(F.col("decision_id").alias("o"), line.alias("text")), "o", "\n").alias("body"))
    block = F.concat(F.lit(f"{heading} "), "category", F.lit("\n"), "body", F.lit("\n"))
    return per.groupBy(by).agg(_joined(F.struct(F.col("first").alias("o"), block.alias("text")), "o", "\n").alias("body"))


def render_components(components: DataFrame, files: DataFrame, decisions: DataFrame) -> DataFrame:
    """component_id, module_id, name, body: a Markdown section a component."""
    item = F.concat(F.lit("- `"), "path", F.lit("`"), F.when(F.col("is_test"), " *(test)*").otherwise(""))
    f = files.groupBy("component_id").agg(_joined(F.struct(F.col("path").alias("o"), item.alias("text")), "o", "\n").alias("files"))
    d = render_decisions(decisions.where("component_id is not null"), "component_id").withColumnRenamed("body", "decided")
    rows = components.join(f, "component_id", "left").join(d, "component_id", "left")
    purpose = F.coalesce(F.nullif("purpose", F.lit("")), F.lit("No purpose specified"))
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), c, F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("### "), "name", F.lit("\n\n**Purpose:** "), purpose, F.lit("\n\n"), part("**Files:**\n", "files"), part("\n**Decisions:**\n\n", "decided"))
    return rows.select("component_id", "module_id", "name", body.alias("body"))


def render_modules(modules: DataFrame, components: DataFrame, files: DataFrame, decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """module_id, file_name, text: one Markdown document a module."""
    from depweave.operators.maptables import module_neighbours

    own = render_decisions(decisions.where("module_id is not null"), "module_id", "###").withColumnRenamed("body", "decided")
    comps = render_components(components, files, decisions).groupBy("module_id").agg(_joined(F.struct("name", "component_id", F.col("body").alias("text")), "name", "\n").alias("parts"))
    near = module_neighbours(modules, edges)
    line = F.concat(F.lit("- "), "neighbour", F.lit(" ("), "edge_type", F.lit(")"))
    text = lambda d: F.array_join(F.array_sort(F.collect_list(F.when(F.col("direction") == d, line))), "\n")
    near = near.groupBy("module_id").agg(text("depends_on").alias("needs"), text("used_by").alias("users"))
    rows = with_doc_filename(modules).join(own, "module_id", "left").join(comps, "module_id", "left").join(near, "module_id", "left")
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {head}\n\n"), c, F.lit("\n\n"))).otherwise("")
    body = F.concat(F.lit("# "), "name", F.lit("\n\n**Classification:** "), F.coalesce("classification", F.lit("")), F.lit("\n\n"), part("Decisions", "decided"), part("Components", "parts"), part("Depends on", "needs"), part("Used by", "users"))
    return rows.select("module_id", "file_name", body.alias("text"))


def render_toc(modules: DataFrame, edges: DataFrame, title: str, created_at: str) -> DataFrame:
    """One row text: a table of contents with links, and all dependencies (F16). The time is given."""
    rows = with_doc_filename(modules)
    toc = rows.agg(_joined(F.struct("name", "module_id", F.format_string("- [%s](%s.md)", "name", "file_name").alias("text")), "name", "\n").alias("toc"))
    names = modules.select("module_id", "name")
    e = edges.join(names.select(F.col("module_id").alias("source_id"), F.col("name").alias("a")), "source_id").join(names.select(F.col("module_id").alias("target_id"), F.col("name").alias("b")), "target_id")
    deps = e.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("- %s -> %s (%s)", "a", "b", "edge_type"))), "\n").alias("deps"))
    return toc.join(F.broadcast(deps)).select(F.concat(F.lit(f"# {title}\n\nGenerated {created_at}\n\n"), "toc", F.lit("\n\n## Dependencies\n\n"), "deps").alias("text"))


def render_tickets(tickets: DataFrame, files: DataFrame) -> DataFrame:
    """ticket_id, text: a ticket as Markdown (F16)."""
    f = files.groupBy("ticket_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- `"), "path", F.lit("`")))), "\n").alias("files"))
    rows = tickets.join(f, "ticket_id", "left")
    return rows.select("ticket_id", F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("description", F.lit("")), F.when(F.coalesce("acceptance_criteria", F.lit("")) != "", F.concat(F.lit("\n\n**Acceptance criteria:**\n"), "acceptance_criteria")).otherwise(""), F.when(F.col("files").isNotNull(), F.concat(F.lit("\n\n**Files:**\n"), "files")).otherwise("")).alias("text"))
