"""Path expressions and the joins and filters built on them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def leaf(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent(path: Column | str) -> Column:
    """The directory of a path; ``.`` at the root."""
    path = _col(path)
    return F.when(F.instr(path, "/") == 0, ".").otherwise(path.substr(F.lit(1), F.length(path) - F.length(leaf(path)) - 1))


def stem(path: Column | str) -> Column:
    """The file name without its last extension; names such as ``.env`` stay whole."""
    return F.regexp_replace(leaf(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """The last extension in lower case with its dot; empty without one."""
    return F.lower(F.regexp_extract(leaf(path), r"(?<=.)(\.[^.]+)$", 1))


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """dir, leaf_dir, grandparent_dir, stem and ext of a path."""
    up = parent(path)
    named = lambda d: F.when(d == ".", "").otherwise(leaf(d))
    return df.withColumns({"dir": up, "leaf_dir": named(up), "grandparent_dir": F.when(up == ".", "").otherwise(named(parent(up))), "stem": stem(path), "ext": extension(path)})


def _first_parts(parts: Column, n: int) -> Column:
    return F.array_join(F.slice(parts, 1, n), "/")


def with_prefix(df: DataFrame, depth: int = 2, path: str = "path", out: str = "prefix") -> DataFrame:
    """The first ``depth`` parts of a path that has more, else its directory; ``.`` for a bare name."""
    parts = F.split(path, "/")
    return df.withColumn(out, F.when(F.size(parts) > depth, _first_parts(parts, depth)).otherwise(parent(path)))


def with_sim_prefix(df: DataFrame, path: str = "path", out: str = "sim_prefix") -> DataFrame:
    """The first two parts of a path of three or more, the first of two, null of one."""
    parts = F.split(path, "/")
    return df.withColumn(out, F.when(F.size(parts) > 2, _first_parts(parts, 2)).when(F.size(parts) == 2, parts[0]))


def _module_dirs(dirs: DataFrame, col: str) -> Column:
    return F.rtrim(F.col(col), F.lit("/"))


def detect_strip_prefix(docs: DataFrame, dirs: DataFrame, path: str = "relative_path", order: str = "doc_ord") -> DataFrame:
    """One row ``prefix``: what stands before the module directory in raw paths.

    ``dirs`` has (dir_ord, directory). Directories in their order; the first one that some path holds past
    its start gives the part before it, of the earliest such document. Empty if there is none. Directories
    of one module are few, and each path is tested against all of them in its own row.
    """
    names = dirs.select(F.collect_list(F.struct("dir_ord", _module_dirs(dirs, "directory").alias("name"))).alias("names"))
    hit = docs.crossJoin(F.broadcast(names)).select(F.col(path).alias("p"), F.col(order).alias("o"), F.explode("names").alias("d"))
    at = F.expr("locate(concat(d.name, '/'), p)")
    found = hit.withColumn("at", at).where("at > 1")
    best = F.min_by(F.expr("substring(p, 1, at - 1)"), F.struct("d.dir_ord", "o"))
    return found.agg(F.coalesce(best, F.lit("")).alias("prefix"))


def detect_add_prefix(docs: DataFrame, dirs: DataFrame, project_root: str, looked: int = 200, path: str = "relative_path", order: str = "doc_ord", strip: str = "") -> DataFrame:
    """One row ``prefix``: what must be put before raw paths so that they fall into the module (P5).

    Empty if one of the first ``looked`` paths (by ``order``), without ``strip`` at its start, is in the module
    already. Else, of the project root (without ``file://``), the part from the first directory that it holds;
    directories in their order.
    """
    root = F.lit(project_root.removeprefix("file://").rstrip("/") + "/")
    own = F.col(path)
    own = F.when(F.startswith(own, F.lit(strip)), F.substring(own, len(strip) + 1, 1 << 30)).otherwise(own) if strip else own
    first = docs.orderBy(order).limit(looked).select(own.alias("path"))
    inside = files_in_module(first, dirs.select("directory")).agg(F.count("*").alias("n"))
    at = F.position(F.concat(F.lit("/"), _module_dirs(dirs, "directory"), F.lit("/")), root)
    tail = dirs.select("dir_ord", at.alias("at")).where("at > 0")
    tail = tail.agg(F.min_by(root.substr(F.col("at") + 1, F.length(root)), "dir_ord").alias("tail"))
    return inside.crossJoin(tail).select(F.when(F.col("n") > 0, "").otherwise(F.coalesce("tail", F.lit(""))).alias("prefix"))


def prepend_prefix(df: DataFrame, prefix: Column | str, path: str = "relative_path") -> DataFrame:
    """Put ``prefix`` (a text ending in ``/``, or a column) before paths, but not before ``../`` ones."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return df.withColumn(path, F.when(F.startswith(F.col(path), F.lit("../")), F.col(path)).otherwise(F.concat(prefix, F.col(path))))


def ancestors(path: Column | str) -> Column:
    """The path itself and every directory above it."""
    parts = F.split(_col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def files_in_module(files: DataFrame, dirs: DataFrame, path: str = "path", directory: str = "directory") -> DataFrame:
    """The files that are one of the directories or below one (W1). An empty directory holds nothing.

    Equality joins on the exploded ancestors; ``src/authorize`` is not below ``src/auth``."""
    wanted = dirs.select(_module_dirs(dirs, directory).alias("_dir")).where("_dir <> ''").distinct()
    keys = files.select(path).distinct().select(path, F.explode(ancestors(path)).alias("_dir"))
    return files.join(keys.join(wanted, "_dir", "left_semi").select(path).distinct(), path, "left_semi")


def module_of_files(files: DataFrame, dirs: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with module_id of each module (``dirs``: module_id, directory) whose directories hold them."""
    wanted = dirs.select("module_id", _module_dirs(dirs, "directory").alias("_dir")).where("_dir <> ''").distinct()
    rows = files.withColumn("_dir", F.explode(ancestors(path)))
    return rows.join(wanted, "_dir").drop("_dir").distinct()


#: What marks a test file: fixed values.
TEST_PATTERNS = [
    r"(^|/)tests?/",
    r"(^|/)test_[^/]+\.\w+$",
    r"(^|/)conftest\.py$",
    r"(^|/)__tests__/",
    r"(^|/)spec/",
    r"(^|/)fixtures?/",
    r"(^|/)mocks?/",
]


def is_test(path: Column | str, patterns: Sequence[str] = TEST_PATTERNS) -> Column:
    return _col(path).rlike("|".join(f"(?:{p})" for p in patterns))


def split_source_test(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Source files and test files."""
    return files.where(~is_test(path)), files.where(is_test(path))


#: Extensions whose files are never read as text: fixed values.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2",
    ".ttf", ".eot", ".otf", ".mp3", ".mp4", ".wav", ".pdf", ".zip",
    ".tar", ".gz", ".db", ".sqlite", ".pyc", ".pyo", ".so", ".dll",
    ".exe", ".bin", ".class", ".jar", ".wasm",
]

#: Extensions of texts that are no source code: fixed values.
TEXT_EXTENSIONS = [
    ".rst", ".adoc", ".json", ".yaml", ".yml", ".toml", ".xml", ".csv", ".tsv",
    ".ini", ".cfg", ".conf", ".properties", ".lock", ".sum", ".env", ".envrc",
    ".log", ".out", ".pid", ".html", ".htm", ".css", ".scss", ".sass", ".less",
    ".svg", ".map", ".gitignore", ".gitattributes", ".editorconfig",
    ".dockerignore", ".prettierrc", ".eslintrc",
]


def filter_source_like(files: DataFrame, skip: Sequence[str] = (*BINARY_EXTENSIONS, *TEXT_EXTENSIONS), path: str = "path") -> DataFrame:
    """Without hidden names, names without extension and the extensions in ``skip`` (lower case)."""
    ext = extension(path)
    return files.where(~F.startswith(leaf(path), F.lit(".")) & (ext != "") & ~ext.isin(list(skip)))


def glob_regex(pattern: str) -> str | None:
    """A glob as a regular expression; None for one that is no glob.

    ``*`` and ``?`` fit any characters, ``/`` too; ``[..]`` fits one of its characters or ranges and ``[!..]`` none of
    them; ``**`` must be a whole part of the path and, before a ``/``, fits any number of directories."""
    out, i = "(?s)", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            n = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            whole = (i == 0 or pattern[i - 1] == "/") and (i + n == len(pattern) or pattern[i + n] == "/")
            if n > 2 or (n == 2 and not whole):
                return None
            directories = n == 2 and i + n < len(pattern)
            out, i = out + ("(?:.*/)?" if directories else ".*"), i + n + directories
        elif c == "[":
            negated = pattern.startswith("!", i + 1)
            start = i + 1 + negated
            end = pattern.find("]", start + 1)  # a ] that comes first stands for itself
            if end < 0:
                return None
            body = re.sub(r"[\\\[\]&^~|]", r"\\\g<0>", pattern[start:end])
            out, i = out + f"[{'^' if negated else ''}{body}]", end + 1
        else:
            out, i = out + ("." if c == "?" else re.escape(c)), i + 1
    return out


def exclude_globs(files: DataFrame, patterns: Sequence[str], path: str = "path") -> DataFrame:
    """Without files whose path or name fits a pattern; ``name/**`` also fits a directory of that name
    anywhere, and what is no glob fits nothing (W4)."""
    full = [x for x in map(glob_regex, patterns) if x is not None]
    if not full:
        return files
    text = "|".join(f"(?:{x})" for x in full)
    names = [p[:-3] for p in patterns if p.endswith("/**") and "/" not in p[:-3]]
    hit = F.col(path).rlike(f"^(?:{text})$") | leaf(path).rlike(f"^(?:{text})$")
    if names:
        hit = hit | F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in names)))
    return files.where(~hit)


def new_files(disk: DataFrame, tracked: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """What is on disk and not tracked."""
    return disk.join(tracked.select(*keys).distinct(), list(keys), "left_anti")


def match_paths(raw: DataFrame, tracked: DataFrame, loose: bool = False) -> DataFrame:
    """raw_path -> path: the same path, else the longest tracked path that ends it at a ``/``.
    ``loose`` also takes an ending within a name. Equality joins on the exploded endings."""
    parts = F.split("raw_path", "/")
    if loose:
        tails = F.transform(F.sequence(F.lit(1), F.length("raw_path")), lambda i: F.col("raw_path").substr(i, F.length("raw_path")))
    else:
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    rows = raw.select("raw_path").distinct().where("raw_path <> ''").select("raw_path", F.explode(tails).alias("path"))
    found = rows.join(tracked.select("path").distinct(), "path")
    return found.groupBy("raw_path").agg(F.max_by("path", F.length("path")).alias("path"))
