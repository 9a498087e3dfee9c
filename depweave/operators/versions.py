"""Snapshots, diffs, validation runs and what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.sources.scratch import numbered

#: All outcomes of a validation: fixed values.
STATUSES = ["confirmed", "updated", "outdated", "new", "implemented", "diverged", "unchanged"]


def decisions_with_names(decisions: DataFrame, components: DataFrame, modules: DataFrame) -> DataFrame:
    """Decisions with component_name and module_name of their owners, '' without one (J1). A component's
    decision has no module name of its own."""
    rows = decisions.join(components.select("component_id", F.col("name").alias("component_name")), "component_id", "left")
    rows = rows.join(modules.select("module_id", F.col("name").alias("module_name")), "module_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("component_name", "module_name")})


def with_owner_module(decisions: DataFrame, components: DataFrame) -> DataFrame:
    """Decisions with owner_module_id: their own module, or that of their component."""
    rows = decisions.join(components.select("component_id", F.col("module_id").alias("_m")), "component_id", "left")
    return rows.withColumn("owner_module_id", F.coalesce("module_id", "_m")).drop("_m")


def create_snapshot(decisions: DataFrame, components: DataFrame, modules: DataFrame, versions: DataFrame, trigger: str, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(version row, frozen decisions) of the next version (C4)."""
    number = versions.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("long").alias("version"))
    rows = decisions_with_names(decisions, components, modules).join(F.broadcast(number))
    summary = snapshot_summary(decisions, components, modules).select(F.to_json(F.struct("*")).alias("summary"))
    row = number.join(F.broadcast(summary)).select("version", F.lit(trigger).alias("trigger"), F.lit(created_at).alias("created_at"), "summary")
    return row, rows.select("version", "decision_id", "module_id", "component_id", "module_name", "component_name", "category", "text", "detail", "source")


def snapshot_summary(decisions: DataFrame, components: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: total, module_level, component_level, modules, components."""
    counts = decisions.agg(F.count("*").alias("total"), F.count("module_id").alias("module_level"), F.count("component_id").alias("component_level"))
    return counts.join(F.broadcast(modules.agg(F.count("*").alias("modules")))).join(F.broadcast(components.agg(F.count("*").alias("components"))))


def list_versions(versions: DataFrame) -> DataFrame:
    """Versions, newest first, with their summary parsed; null where it is no JSON."""
    schema = "total long, module_level long, component_level long, modules long, components long"
    parsed = F.when(F.try_parse_json("summary").isNotNull(), F.from_json("summary", schema))
    return versions.withColumn("summary", parsed).orderBy(F.desc("version"))


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """decision_id, change, then of both sides category, text and source, and the names of the owners, by decision_id
    (J6): ``added``, ``removed``, ``changed`` (category or text), ``unchanged``. Names are the new side's, of a removed
    decision the old side's. Rows without decision_id are left out; a side may lack source and names."""
    def side(df: DataFrame, p: str) -> DataFrame:
        own = [F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("category", "text", "source", "module_name", "component_name")]
        names = [f"{p}_category", f"{p}_text", f"{p}_source", f"_{p}_module", f"_{p}_component"]
        return df.where("decision_id is not null").select("decision_id", *(c.alias(n) for c, n in zip(own, names, strict=True)), F.lit(True).alias(f"_{p}"))

    rows = side(old, "old").join(side(new, "new"), "decision_id", "full_outer")
    same = F.col("old_category").eqNullSafe(F.col("new_category")) & F.col("old_text").eqNullSafe(F.col("new_text"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    name = lambda c: F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(f"{c}_name")
    return rows.select("decision_id", change.alias("change"), name("module"), name("component"), "old_category", "new_category", "old_text", "new_text", "old_source", "new_source")


def change_counts(diff: DataFrame) -> DataFrame:
    """One row: added, removed, changed, unchanged of a version diff."""
    return diff.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "unchanged")))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest completed run (by created_at, then id)."""
    return runs.where("status = 'completed'").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id")).where("run_id is not null")


def validation_summary(runs: DataFrame, outcomes: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the newest completed run: counts by status, and the non-trivial outcomes with the owners of the live
    decisions (J5, W11)."""
    own = outcomes.join(F.broadcast(latest_run(runs)), "run_id", "left_semi")
    rows = own.where(~F.col("status").isin("confirmed", "unchanged"))
    live = decisions.select("decision_id", "module_id", "component_id")
    return own.groupBy("status").agg(F.count("*").alias("n")), rows.join(live, "decision_id", "left")


def validation_overview(runs: DataFrame, outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row (J5): run_id of the newest completed run (null without one), the ids of modules and components that its
    non-trivial outcomes touch, in order, and the new_file_paths of its summary. Ids other than 0 count."""
    _, rows = validation_summary(runs, outcomes, decisions)
    ids = rows.agg(*(F.array_sort(F.collect_set(F.when(F.col(c) != 0, F.col(c)))).alias(f"affected_{c}s") for c in ("module_id", "component_id")))
    run = runs.join(F.broadcast(latest_run(runs)), "run_id", "left_semi")
    paths = F.from_json(run["summary"] if "summary" in runs.columns else F.lit(None).cast("string"), "new_file_paths array<string>")["new_file_paths"]
    one = run.agg(F.max("run_id").alias("run_id"), F.first(paths).alias("_paths"))
    return one.join(F.broadcast(ids)).select("run_id", "affected_module_ids", "affected_component_ids", F.coalesce("_paths", F.array().cast("array<string>")).alias("new_file_paths"))


def validation_stats(outcomes: DataFrame, by: str = "run_id") -> DataFrame:
    """Counts of each of the seven statuses, 0 where there is none."""
    return outcomes.groupBy(by).pivot("status", STATUSES).agg(F.count(F.lit(1))).na.fill(0, STATUSES)


def start_run(runs: DataFrame, before_version: int, created_at: str) -> DataFrame:
    """The row of a new run."""
    number = runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).cast("long").alias("run_id"))
    return number.select("run_id", F.lit(before_version).cast("long").alias("before_version"), F.lit(None).cast("long").alias("after_version"), F.lit("running").alias("status"), F.lit(created_at).alias("created_at"), F.lit(None).cast("string").alias("summary"))


def complete_run(runs: DataFrame, run_id: int, after_version: int, summary: str, status: str = "completed") -> DataFrame:
    """``runs`` with the run closed."""
    hit = F.col("run_id") == run_id
    return runs.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in (("after_version", after_version), ("status", status), ("summary", summary))})


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id"))


def apply_validations(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Live decisions after a run (C7): ``updated`` outcomes give new text, ``new`` ones are added with ids
    after the largest; human decisions stay as they are. ``outcomes``: ord, decision_id, status, new_text,
    category, module_id, component_id."""
    texts = outcomes.where("status = 'updated' and new_text is not null").groupBy("decision_id").agg(F.max_by("new_text", "ord").alias("_t"))
    rows = decisions.join(texts, "decision_id", "left").withColumn("text", F.when(F.col("source") != "human", F.coalesce("_t", "text")).otherwise(F.col("text")))
    top = decisions.agg(F.coalesce(F.max("decision_id"), F.lit(0)).alias("_top"))
    fresh = numbered(outcomes.where("status = 'new'"), ["ord"], "_n").join(F.broadcast(top))
    fresh = fresh.select((F.col("_top") + F.col("_n")).cast("long").alias("decision_id"), "module_id", "component_id", "category", F.col("new_text").alias("text"), F.lit("pipeline_generated").alias("source"))
    return rows.select(decisions.columns).unionByName(fresh, allowMissingColumns=True).select(decisions.columns)


def apply_elevation(decisions: DataFrame, elevated: DataFrame) -> DataFrame:
    """Module decisions in place of the component decisions that they sum up (C8). ``elevated``: ord, module_id,
    category, text, detail, source_ids (array of decision ids)."""
    gone = elevated.select(F.explode("source_ids").alias("decision_id")).distinct()
    top = decisions.agg(F.coalesce(F.max("decision_id"), F.lit(0)).alias("_top"))
    rows = numbered(elevated, ["ord"], "_n").join(F.broadcast(top))
    rows = rows.select((F.col("_top") + F.col("_n")).cast("long").alias("decision_id"), "module_id", "category", "text", "detail", F.lit("pipeline_generated").alias("source"))
    return decisions.join(gone, "decision_id", "left_anti").unionByName(rows, allowMissingColumns=True).select(decisions.columns)


def clear_generated(decisions: DataFrame) -> DataFrame:
    """Without generated decisions."""
    return decisions.where(F.coalesce("source", F.lit("")) != "pipeline_generated")


def join_validations(responses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Validation responses with the decisions they speak of; old_text stays only for ``updated``."""
    own = decisions.select("decision_id", "module_id", "component_id", "category", F.col("text").alias("old_text"), "source")
    rows = responses.join(own, "decision_id", "left")
    return rows.withColumn("old_text", F.when(F.col("status") == "updated", F.col("old_text")))


def decision_badges(decisions: DataFrame, changes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """decision_id with the action of its last change record and its last validation outcome."""
    last = changes.where("entity_type = 'decision'").groupBy(F.col("entity_id").alias("decision_id")).agg(F.max_by("action", "ord").alias("action"))
    outcome = outcomes.groupBy("decision_id").agg(F.max_by(F.struct("status", "old_text", "reason"), "ord").alias("o"))
    rows = decisions.select("decision_id").join(last, "decision_id", "left").join(outcome, "decision_id", "left")
    return rows.select("decision_id", "action", "o.status", "o.old_text", "o.reason")


def flag_new_files(component_files: DataFrame, summary_paths: DataFrame) -> DataFrame:
    """Files with ``is_new``: whether the last run's summary lists them (J25). ``summary_paths``: paths (array)."""
    new = summary_paths.select(F.explode("paths").alias("path")).distinct().withColumn("_new", F.lit(True))
    return component_files.join(new, "path", "left").withColumn("is_new", F.coalesce("_new", F.lit(False))).drop("_new")
