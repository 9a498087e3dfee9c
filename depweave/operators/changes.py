"""The change log: records, net deltas, baselines, edits of live tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.sources.scratch import numbered


def record_changes(before: DataFrame, after: DataFrame, key: Sequence[str], origin: str, baseline: int | None, fields: Sequence[str]) -> DataFrame:
    """key, action, old_value, new_value, origin, baseline_id for every row added, removed or edited.

    Values are JSON of ``fields``; rows that are the same in all of them give no record."""
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    a = before.select(*key, body.alias("old_value"))
    b = after.select(*key, body.alias("new_value"))
    rows = a.join(b, list(key), "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    action = F.when(F.col("old_value").isNull(), "add").when(F.col("new_value").isNull(), "remove").otherwise("edit")
    return rows.select(*key, action.alias("action"), "old_value", "new_value", F.lit(origin).alias("origin"), F.lit(baseline).cast("long").alias("baseline_id"))


def normal_json(text: Column) -> Column:
    """JSON in one spelling (object keys in order), so that equal values compare equal; other text as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def collapse_state(changes: DataFrame, key_cols: Sequence[str] = ("entity_type", "entity_id"), order_cols: Sequence[str] = ("ord",)) -> DataFrame:
    """Per entity (n, first, last): all that a net delta needs. Two such states merge into one."""
    rest = [c for c in changes.columns if c not in key_cols]
    row, order = F.struct(*rest), F.struct(*order_cols)
    return changes.groupBy(*key_cols).agg(F.count("*").alias("n"), F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))


def merge_states(a: DataFrame, b: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One state of two over disjoint records."""
    at = lambda end: F.struct(*(F.col(f"{end}.{c}") for c in order_cols))
    both = a.unionByName(b)
    return both.groupBy(*key_cols).agg(F.sum("n").alias("n"), F.min_by("first", at("first")).alias("first"), F.max_by("last", at("last")).alias("last"))


def net_changes(states: DataFrame, key_cols: Sequence[str] = ("entity_type", "entity_id")) -> DataFrame:
    """The net record of each state; none for what was added and removed, or edited back.

    Fields other than action and values come from the first record, of a net removal from the last."""
    first, last = F.col("first.action"), F.col("last.action")
    one = F.col("n") == 1
    action = F.when(one, first).when(first == "add", "add").when(last == "remove", "remove").otherwise("edit")
    nothing = ~one & ((first == "add") & (last == "remove") | (action == "edit") & normal_json(F.col("first.old_value")).eqNullSafe(normal_json(F.col("last.new_value"))))
    rows = states.where(~F.coalesce(nothing, F.lit(False))).withColumn("_action", action)
    rest = [f.name for f in states.schema["first"].dataType.fields if f.name not in ("action", "old_value", "new_value")]
    removed = ~one & (F.col("_action") == "remove")
    return rows.select(
        *key_cols,
        F.col("_action").alias("action"),
        F.when(one | (F.col("_action") != "add"), F.col("first.old_value")).alias("old_value"),
        F.when(one | (F.col("_action") != "remove"), F.col("last.new_value")).alias("new_value"),
        *(F.when(removed, F.col(f"last.{c}")).otherwise(F.col(f"first.{c}")).alias(c) for c in rest),
    )


def collapse_changes(changes: DataFrame, key_cols: Sequence[str] = ("entity_type", "entity_id"), order_cols: Sequence[str] = ("ord",)) -> DataFrame:
    """The net delta of each entity in one aggregation (C2). ``order_cols`` must order an entity's records
    totally."""
    return net_changes(collapse_state(changes, key_cols, order_cols), key_cols)


def changes_since(changes: DataFrame, baselines: DataFrame) -> DataFrame:
    """Records of the current baseline (largest id); all records where there is no baseline."""
    current = baselines.agg(F.max("baseline_id").alias("_current"))
    return changes.join(F.broadcast(current)).where(F.col("_current").isNull() | (F.col("baseline_id") == F.col("_current"))).drop("_current")


def new_baseline(baselines: DataFrame, created_at: str) -> DataFrame:
    """``baselines`` with one more."""
    one = baselines.agg((F.coalesce(F.max("baseline_id"), F.lit(0)) + 1).cast("long").alias("baseline_id")).withColumn("created_at", F.lit(created_at))
    return baselines.select("baseline_id", "created_at").unionByName(one)


def current_baseline(baselines: DataFrame) -> DataFrame:
    return baselines.agg(F.max("baseline_id").alias("baseline_id"), F.max_by("created_at", "baseline_id").alias("created_at"))


def update_decisions(decisions: DataFrame, patches: DataFrame, editor: str = "human") -> DataFrame:
    """Given (non-null) patch columns replace the old ones, and the source becomes the editor (C14).
    ``patches``: decision_id and any of category, text, detail; one row a decision."""
    given = [c for c in patches.columns if c != "decision_id"]
    rows = decisions.join(patches.select("decision_id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in given)), "decision_id", "left")
    changed = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in given} | {"source": F.when(F.col("_hit"), F.lit(editor)).otherwise(F.col("source"))}
    return rows.withColumns(changed).select(decisions.columns)


def insert_unique(table: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(inserted, conflicts) of ``new``: the first by ``order`` of each key that the table lacks goes in.
    A key with a null is never a conflict."""
    blank = F.greatest(*(F.col(c).isNull() for c in key)) if len(key) > 1 else F.col(key[0]).isNull()
    rows = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("_free", blank)
    known = table.select(*key).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, list(key), "left")
    ok = F.col("_free") | ((F.col("_rn") == 1) & F.col("_known").isNull())
    return rows.where(ok).select(new.columns), rows.where(~ok).select(new.columns)


def apply_proposals(proposals: DataFrame, selected: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, decisions, skipped) after the selected pending proposals are applied.

    ``proposals``: proposal_id, status, action (add, edit, remove), decision_id, category, text, detail;
    ``selected``: proposal_id. Pending ones that aren't selected become ``rejected``. Selected ones that
    aren't pending are skipped."""
    own = proposals.join(selected.select("proposal_id").distinct().withColumn("_sel", F.lit(True)), "proposal_id", "left").withColumn("_sel", F.coalesce("_sel", F.lit(False)))
    go = own.where("_sel and status = 'pending'")
    removed = go.where("action = 'remove'").select("decision_id")
    patches = go.where("action = 'edit'").groupBy("decision_id").agg(*(F.max_by(c, "proposal_id").alias(c) for c in ("category", "text", "detail")))
    live = update_decisions(decisions.join(removed, "decision_id", "left_anti"), patches, "chat")
    top = decisions.agg(F.coalesce(F.max("decision_id"), F.lit(0)).alias("_top"))
    added = numbered(go.where("action = 'add'"), ["proposal_id"], "_n").join(F.broadcast(top))
    added = added.select((F.col("_top") + F.col("_n")).cast("long").alias("decision_id"), "category", "text", "detail", F.lit("chat").alias("source"))
    live = live.unionByName(added, allowMissingColumns=True)
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("_sel"), "applied").otherwise("rejected")
    return own.withColumn("status", status).select(proposals.columns), live.select(decisions.columns), own.where("_sel and status <> 'pending'").select(proposals.columns)
