"""Languages by extension and config file: fixed values, and the reports over a file table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (language, extensions, aliases): fixed values.
LANGUAGES = [
    ("TypeScript", ["ts", "tsx", "mts", "cts"], ["typescript", "ts"]),
    ("JavaScript", ["js", "jsx", "mjs", "cjs"], ["javascript", "js"]),
    ("Python", ["py", "pyi", "pyw"], ["python", "py"]),
    ("C#", ["cs", "csx"], ["csharp", "c#", "cs"]),
    ("Java", ["java"], ["java"]),
    ("Kotlin", ["kt", "kts"], ["kotlin", "kt"]),
    ("Scala", ["scala", "sc"], ["scala"]),
    ("Go", ["go"], ["go", "golang"]),
    ("Rust", ["rs"], ["rust", "rs"]),
    ("Ruby", ["rb", "rake", "gemspec"], ["ruby", "rb"]),
    ("PHP", ["php", "phtml", "php3", "php4", "php5", "phps"], ["php"]),
    ("C++", ["cpp", "cxx", "cc", "c++", "hpp", "hxx", "hh", "h++"], ["cpp", "c++"]),
    ("C", ["c", "h"], ["c"]),
    ("Dart", ["dart"], ["dart"]),
]

#: File names that tell of a language: fixed values.
CONFIG_FILES = [
    ("package.json", "JavaScript"),
    ("tsconfig.json", "TypeScript"),
    ("pyproject.toml", "Python"),
    ("setup.py", "Python"),
    ("requirements.txt", "Python"),
    ("Pipfile", "Python"),
    ("Cargo.toml", "Rust"),
    ("go.mod", "Go"),
    ("go.sum", "Go"),
    ("pom.xml", "Java"),
    ("build.gradle", "Java"),
    ("build.gradle.kts", "Java"),
    ("Gemfile", "Ruby"),
    ("composer.json", "PHP"),
    ("pubspec.yaml", "Dart"),
]

#: Extensions that count as config files of C#: fixed values.
CONFIG_EXTENSIONS = [("csproj", "C#"), ("sln", "C#")]

#: What is left out by default: fixed values.
DEFAULT_EXCLUDES = ["node_modules/**", ".git/**", "target/**", "dist/**", "build/**", "__pycache__/**", ".venv/**", "venv/**", ".env/**", "env/**", "*.min.js", "*.min.css"]


def language_table(spark: SparkSession) -> DataFrame:
    """language, ext."""
    return spark.createDataFrame([(name, e) for name, exts, _ in LANGUAGES for e in exts], "language string, ext string")


def classified(files: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """``files`` (path) with ext as written, language, config_of (a language) and excluded."""
    from depweave.functions.paths import exclude_globs, leaf

    spark = files.sparkSession
    rows = files.select("path").distinct()
    kept = exclude_globs(rows, DEFAULT_EXCLUDES if excludes is None else excludes).withColumn("_kept", F.lit(True))
    rows = rows.join(kept, "path", "left").select("path", F.col("_kept").isNull().alias("excluded"))
    rows = rows.withColumn("name", leaf("path")).withColumn("ext", F.regexp_extract("name", r"(?<=.)\.([^.]+)$", 1))
    names = spark.createDataFrame(CONFIG_FILES, "name string, _c string")
    kinds = spark.createDataFrame(CONFIG_EXTENSIONS, "ext string, _e string")
    rows = rows.join(F.broadcast(language_table(spark)), "ext", "left").join(F.broadcast(names), "name", "left").join(F.broadcast(kinds), "ext", "left")
    return rows.select("path", "ext", "language", F.coalesce("_c", "_e").alias("config_of"), "excluded")


def language_report(files: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """language, source_files, config_files of languages with a source file."""
    rows = classified(files, excludes).where("not excluded")
    source = rows.where("language is not null").groupBy("language").agg(F.count("*").alias("source_files"))
    config = rows.where("config_of is not null").groupBy(F.col("config_of").alias("language")).agg(F.count("*").alias("config_files"))
    return source.join(config, "language", "left").select("language", "source_files", F.coalesce("config_files", F.lit(0)).alias("config_files"))


def unrecognised(files: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """ext (lower case), n of files without a known extension; files without any aren't listed."""
    rows = classified(files, excludes).where("not excluded and language is null and ext <> ''")
    return rows.groupBy(F.lower("ext").alias("ext")).agg(F.count("*").alias("n"))


def coverage(files: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """One row: total, supported, excluded files and coverage in percent of the total."""
    rows = classified(files, excludes)
    sums = rows.agg(F.count_if(~F.col("excluded")).alias("total"), F.count_if(~F.col("excluded") & F.col("language").isNotNull()).alias("supported"), F.count_if("excluded").alias("excluded"))
    return sums.withColumn("coverage", F.when(F.col("total") > 0, F.col("supported") * 100.0 / F.col("total")).otherwise(0.0))


def coverage_summary(counts: DataFrame, top: int = 5) -> DataFrame:
    """rank, label, n: the ``top`` unrecognised extensions and one row for the rest (A18). ``counts``: ext, n."""
    first = counts.orderBy(F.desc("n"), "ext").limit(top)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "ext")))  # ``top`` rows
    rest = counts.join(F.broadcast(first.select("ext")), "ext", "left_anti").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 0")
    more = F.format_string("... and %d more extensions (%d files)", "k", "n")
    return ranked.select("rank", F.concat(F.lit("."), "ext").alias("label"), "n").unionByName(rest.select(F.lit(top + 1).alias("rank"), more.alias("label"), "n"))


def filter_languages(df: DataFrame, aliases: list[str]) -> DataFrame:
    """Rows of the languages that the aliases name (any case); no aliases: all rows; unknown ones alone: none."""
    if not aliases:
        return df
    wanted = {a.strip().lower() for a in aliases}
    names = [name for name, _, known in LANGUAGES if wanted & {*known}]
    return df.where(F.col("language").isin(names))
