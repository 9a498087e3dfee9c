"""Path and symbol expressions, membership, globs, suffix matches."""

import pytest
from pyspark.sql import functions as F

from depweave.functions import paths, symbols


def table(spark, values, name="path"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def got(df, col="path"):
    return sorted(r[0] for r in df.select(col).collect())


def test_path_parts(spark):
    rows = paths.with_path_parts(table(spark, ["a/b/c.tar.GZ", "x.py", ".env", "a/.env", "d/e", None])).collect()
    have = {r.path: (r.dir, r.leaf_dir, r.grandparent_dir, r.stem, r.ext) for r in rows}
    assert have["a/b/c.tar.GZ"] == ("a/b", "b", "a", "c.tar", ".gz")
    assert have["x.py"] == (".", "", "", "x", ".py")
    assert have[".env"][3:] == (".env", "") and have["a/.env"][:3] == ("a", "a", "")
    assert have["d/e"][3:] == ("e", "")


def test_prefixes(spark):
    rows = paths.with_sim_prefix(paths.with_prefix(table(spark, ["a/b/c/d.py", "a/b/c.py", "a/b.py", "b.py"]))).collect()
    assert {r.path: (r.prefix, r.sim_prefix) for r in rows} == {"a/b/c/d.py": ("a/b", "a/b"), "a/b/c.py": ("a/b", "a/b"), "a/b.py": ("a", "a"), "b.py": (".", None)}


def test_membership(spark):
    files = table(spark, ["src/auth/login.py", "src/authorize/x.py", "src/auth", "other.py"])
    for directory in ("src/auth", "src/auth/"):
        assert got(paths.files_in_module(files, table(spark, [directory], "directory"))) == ["src/auth", "src/auth/login.py"]
    assert got(paths.files_in_module(files, table(spark, [""], "directory"))) == []
    assert got(paths.files_in_module(files, table(spark, [], "directory"))) == []
    dirs = spark.createDataFrame([(1, "src"), (2, "src/auth/")], "module_id long, directory string")
    assert sorted((r.module_id, r.path) for r in paths.module_of_files(files, dirs).collect()) == [(1, "src/auth"), (1, "src/auth/login.py"), (1, "src/authorize/x.py"), (2, "src/auth"), (2, "src/auth/login.py")]


def test_strip_and_add_prefix(spark):
    docs = spark.createDataFrame([("repo/src/a.py", 1), ("src/b.py", 0), ("other/src/c.py", 2)], "relative_path string, doc_ord long")
    dirs = spark.createDataFrame([(0, "lib"), (1, "src")], "dir_ord int, directory string")
    assert paths.detect_strip_prefix(docs, dirs).first()[0] == "repo/"
    assert paths.detect_strip_prefix(docs, dirs.where("dir_ord = 0")).first()[0] == ""
    inner = spark.createDataFrame([("a.py", 0)], "relative_path string, doc_ord long")
    assert paths.detect_add_prefix(inner, dirs, "file:///home/x/src/core").first()[0] == "src/core/"
    assert paths.detect_add_prefix(docs, dirs, "file:///home/x/src/core").first()[0] == ""
    assert paths.detect_add_prefix(inner, dirs, "file:///home/o'neil/src/core/").first()[0] == "src/core/"
    out = spark.createDataFrame([("repo/src/a.py", 0)], "relative_path string, doc_ord long")
    assert paths.detect_add_prefix(out, dirs, "/x/src/core").first()[0] == "src/core/"
    assert paths.detect_add_prefix(out, dirs, "/x/src/core", strip="repo/").first()[0] == ""
    moved = paths.prepend_prefix(table(spark, ["a.py", "../b.py"], "relative_path"), "p/")
    assert got(moved, "relative_path") == ["../b.py", "p/a.py"]


def test_test_files(spark):
    tests = ["tests/test_auth.py", "pkg/test/helpers.py", "src/test_utils.py", "conftest.py", "__tests__/App.test.js", "spec/models/user_spec.rb", "fixtures/data.json", "mocks/a.py"]
    sources = ["src/auth.py", "latest/x.py", "src/contest.py", "inspect/y.py"]
    a, b = paths.split_source_test(table(spark, tests + sources))
    assert got(a) == sorted(sources) and got(b) == sorted(tests)


def test_filters(spark):
    files = table(spark, ["a.py", ".hidden.py", "Makefile", "x.PNG", "node_modules/a/b.js", "src/node_modules/c.js", "m.min.js", "d/m.min.js", "src/deep/z.ts"])
    assert got(paths.filter_source_like(files, [".png", ".js"])) == ["a.py", "src/deep/z.ts"]
    left = got(paths.exclude_globs(files, ["node_modules/**", "*.min.js", "src/**/*.ts"]))
    assert left == [".hidden.py", "Makefile", "a.py", "x.PNG"]
    assert got(paths.exclude_globs(files, [])) == got(files)
    assert got(paths.filter_source_like(table(spark, ["a.py", "b.json", "c.md", "d.PNG", "e.css", ".f.py", "g", "h/i.rs"]))) == ["a.py", "c.md", "h/i.rs"]


def test_globs(spark):
    names = ["src/a.js", "src/d/b.js", "x1.py", "xa.py", "x].py", "d/x2.py", "a/b/c", "a/c", "q-1", "w^", "n\nl.py"]
    files = table(spark, names)
    cases = {
        "src/*.js": {"src/a.js", "src/d/b.js"}, "x[0-9].py": {"x1.py", "d/x2.py"}, "x[!0-9].py": {"xa.py", "x].py"}, "x[]].py": {"x].py"}, "a/**/c": {"a/b/c", "a/c"}, "a/?/c": {"a/b/c"},
        "**": set(names), "a**": set(), "[x": set(), "***": set(), "q[-]1": {"q-1"}, "w[^a]": {"w^"}, "*.py": {"x1.py", "xa.py", "x].py", "d/x2.py", "n\nl.py"}, "": set(),
    }
    for pattern, gone in cases.items():
        assert set(got(paths.exclude_globs(files, [pattern]))) == set(names) - gone, pattern


def test_match_paths(spark):
    tracked = table(spark, ["main.py", "backend/main.py", "x/y.py"])
    raw = table(spark, ["repo/backend/main.py", "main.py", "xmain.py", "none.py"], "raw_path")
    assert {r.raw_path: r.path for r in paths.match_paths(raw, tracked).collect()} == {"repo/backend/main.py": "backend/main.py", "main.py": "main.py"}
    assert {r.raw_path: r.path for r in paths.match_paths(raw, tracked, loose=True).collect()}["xmain.py"] == "main.py"


@pytest.mark.parametrize("roles,definition", [(1, True), (3, True), (5, True), (0, False), (2, False), (4, False), (None, False)])
def test_definition_bit(spark, roles, definition):
    row = spark.createDataFrame([("s", roles, 0)], "symbol string, symbol_roles int, kind int")
    assert symbols.with_symbol_flags(row).first().is_definition is definition


def test_symbol_flags_and_names(spark):
    cases = {("local 42", 0): (True, False), ("mymod/`func`(a, b).", 0): (False, True), ("something()", 0): (False, False), ("x", 17): (False, True), ("f().", 5): (False, False), ("f().", None): (False, True), ("x", 999): (False, False)}
    rows = spark.createDataFrame([(s, 0, k) for s, k in cases], "symbol string, symbol_roles int, kind int")
    for r in symbols.with_symbol_flags(rows).collect():
        assert (r.is_local, r.is_callable) == cases[(r.symbol, r.kind)], r
    kinds = spark.createDataFrame([("s", 0, k) for k in symbols.CALLABLE_KINDS], "symbol string, symbol_roles int, kind int")
    assert kinds.where(~symbols.is_callable()).count() == 0
    names = {"a/b/Foo#": "Foo", "a/f().": "f()", "plain": "plain", "a/#": "a/#", "x/`m`/y.": "y"}
    for r in spark.createDataFrame([(s,) for s in names], "symbol string").select("symbol", symbols.symbol_name().alias("n"), symbols.symbol_module().alias("m")).collect():
        assert r.n == names[r.symbol]
        assert r.m == ("m" if "`" in r.symbol else None)
    assert [r[0] for r in spark.createDataFrame([(17,), (999,)], "kind int").select(symbols.kind_name()).collect()] == ["Function", None]
