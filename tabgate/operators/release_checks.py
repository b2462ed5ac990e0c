"""Checks against earlier releases and other submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.functions.faults import ISSUE_KEYS, emit, fault, prefix
from tabgate.operators.lookup import attach, counted
from tabgate.operators.properties import corrected_records, on_nodes

NODE_KEY = ["data_commons", "node_type", "node_id"]
# Intentions and states of submissions and releases.
NEW_UPDATE, DELETE = "New/Update", "Delete"
SUBMITTED, RELEASED, DELETED = "Submitted", "Released", "Deleted"
NOT_ASKED_IF_RELEASED = ("M003", "M013")


def released_nodes(releases: DataFrame) -> DataFrame:
    """One row per released node (status Released or none), with its properties and parents."""
    alive = releases.filter(F.col("status").isNull() | (F.col("status") == RELEASED))
    return alive.groupBy(*NODE_KEY).agg(
        F.min_by(F.struct("props", "parents"), "release_id").alias("old")
    )


def with_release(records: DataFrame, releases: DataFrame) -> DataFrame:
    """Records with the released row of the same node; rows of hot node ids are spread."""
    weights = counted(records, NODE_KEY, name="n_rows")
    facts = released_nodes(releases).join(weights, NODE_KEY)
    return attach(records, facts, NODE_KEY, "n_rows", spread_by=["record_id"]).drop("n_rows")


def differs() -> Column:
    """True when the new content changes the released one: a property that is not there yet, a filled
    value that is different, or other parents."""
    old_props, old_parents = F.col("old.props"), F.coalesce(F.col("old.parents"), F.array())
    new_parents = F.coalesce(F.col("parents"), F.array())
    prop_changes = F.exists(
        F.map_entries("props"),
        lambda e: ~F.map_contains_key(old_props, e["key"])
        | (F.coalesce(e["value"] != "", F.lit(False)) & ~e["value"].eqNullSafe(F.try_element_at(old_props, e["key"]))),
    )
    return (
        prop_changes
        | (F.size(new_parents) != F.size(old_parents))
        | (F.size(F.array_except(new_parents, old_parents)) > 0)
    )


def compared(records: DataFrame, releases: DataFrame, submissions: DataFrame) -> DataFrame:
    """The records that F1 and F2 are about, with their intention and released row: updates of released nodes, deletions of
    others."""
    intent = submissions.select("submission_id", "intention").filter(F.col("intention").isin(NEW_UPDATE, DELETE))
    found = F.col("old").isNotNull()
    return with_release(records.join(intent, "submission_id"), releases).filter(
        F.when(F.col("intention") == NEW_UPDATE, found).otherwise(~found)
    )


def release_issues(
    records: DataFrame, releases: DataFrame, submissions: DataFrame, facts: DataFrame, fixes: DataFrame | None = None
) -> DataFrame:
    """F1 (M018) and F2 (M019). ``records`` must carry the corrected properties, or ``fixes`` (record_id, prop, new_value)
    tell them; only records with a released row then meet their fixes."""
    rows = compared(records, releases, submissions)
    return compared_issues(rows if fixes is None else corrected_records(rows, fixes), facts)


def compared_issues(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """F1, F2 on rows of ``compared`` with the corrected properties."""
    rows = on_nodes(rows, facts)
    found = F.col("old").isNotNull()
    update = (F.col("intention") == NEW_UPDATE) & found & differs()
    id_prop, node_id, kind = F.col("model_id_prop"), F.col("node_id"), F.col("node_type")
    shown = F.concat(id_prop, F.lit(": "), node_id)
    of_file = F.format_string(
        '%s “%s”: {“%s": “%s"} already exists and will be updated. Its associated data file will also be'
        " replaced if uploaded.", prefix(), kind, id_prop, node_id,
    )
    is_file = F.coalesce("is_file", F.lit(False))
    template = F.format_string('%s "%s": "%s" : already exists and will be updated.', prefix(), kind, shown)
    return emit(
        rows,
        [
            fault("M018", update, "nodeID", id_prop, description=F.when(is_file, of_file).otherwise(template)),
            fault("M019", (F.col("intention") == DELETE) & ~found, "nodeID", id_prop, prefix(), kind, node_id),
        ],
    )


def without_pardoned(issues: DataFrame, records: DataFrame, releases: DataFrame, submissions: DataFrame) -> DataFrame:
    """a released row exists, so M003 and M013 are not raised for an update or a deletion.

    Issues that carry the ``data_commons`` of their record don't meet the records again."""
    asked = F.col("code").isin(*NOT_ASKED_IF_RELEASED)
    intent = submissions.filter(F.col("intention").isin(NEW_UPDATE, DELETE)).select("submission_id")
    # Only the issues in question travel.
    some = issues.filter(asked)
    keyed = some if "data_commons" in issues.columns else some.join(
        records.select("record_id", "data_commons"), "record_id"
    )
    alive = released_nodes(releases).select(*NODE_KEY)
    pardoned = (
        keyed.join(intent, "submission_id", "left_semi").join(alive, NODE_KEY, "left_semi")
        .select("record_id").distinct()
    )
    return issues.filter(~asked).unionByName(some.join(pardoned, "record_id", "left_anti"))


# --- F4 ----------------------------------------------------------------------------------------

CROSS_KEY = ["study_id", *NODE_KEY]


def cross_members(records: DataFrame, submissions: DataFrame) -> DataFrame:
    """Which Submitted or Released submissions of a study hold a node; one row each, once."""
    live = submissions.filter(F.col("status").isin(SUBMITTED, RELEASED)).select("submission_id", "study_id")
    return records.drop("study_id").join(live, "submission_id").select(*CROSS_KEY, "submission_id").distinct()


def cross_submission_issues(records: DataFrame, submissions: DataFrame) -> DataFrame:
    """F4 (S001): the same node in another submission of the study.

    Groups are counted, never paired. The value tells how many others there are; cross_members has
    them all, one row each.
    """
    members = cross_members(records, submissions)
    shared = counted(members, CROSS_KEY, at_least=2, name="n_submissions")
    live = submissions.filter(F.col("status").isin(SUBMITTED, RELEASED)).select("submission_id", "study_id")
    rows = records.drop("study_id").join(live, "submission_id")
    weights = counted(rows, CROSS_KEY, name="n_rows")
    facts = shared.join(weights, CROSS_KEY)
    hit = attach(rows, facts, CROSS_KEY, "n_rows", spread_by=["record_id"]).filter(F.col("n_submissions").isNotNull())
    return emit(
        hit,
        [fault("S001", F.lit(True), "conflictingSubmissions",
               F.format_string("%s submissions", F.col("n_submissions") - 1), prefix())],
        keep=(*ISSUE_KEYS, "n_submissions"),
    )


