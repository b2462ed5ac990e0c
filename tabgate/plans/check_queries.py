"""Queries over the driver tables: scans, property, relationship and release checks, roll-ups."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tabgate.operators import issues as roll
from tabgate.operators import properties as P
from tabgate.operators import relations as R
from tabgate.operators import release_checks as X
from tabgate.plans import star, validate
from tabgate.session import stage
from tabgate.sources import records as scans

ISSUE = ("record_id", "code", "offending_property", "offending_value")
_READY: dict[tuple[str, str], tuple[validate.Context, validate.Prepared]] = {}
_CHECKED: dict[tuple[str, str], validate.Checked] = {}


def context(spark: SparkSession, sf_dir: str) -> tuple[validate.Context, validate.Prepared]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _READY:
        ctx = validate.Context(
            submissions=star.stored_submissions(spark, sf_dir), studies=star.studies(spark, sf_dir),
            organizations=star.organizations(spark, sf_dir), model_nodes=star.model_nodes(spark),
            model_props=star.model_props(spark), model_rels=star.model_rels(spark), cde=star.cde(spark, sf_dir),
            synonyms=star.synonyms(spark, sf_dir), releases=star.stored(spark, sf_dir, "releases"),
            program_prop="name", study_prop="name", consent_type="nation",
            concept_codes=star.concept_codes(spark, sf_dir),
        )
        _READY[key] = (ctx, validate.prepare(ctx))
    return _READY[key]


def records(spark, sf_dir):
    return star.stored(spark, sf_dir, "records")


def cells(spark, sf_dir):
    _, ready = context(spark, sf_dir)
    return P.cells(records(spark, sf_dir), ready.rules, ready.facts)


def named(spark, sf_dir):
    return validate.named_cells(records(spark, sf_dir), *context(spark, sf_dir))


def _required(code):
    return lambda s, d: P.cell_issues(cells(s, d), P.required_faults(), codes=[code]).select(*ISSUE)


def _typed(*codes):
    return lambda s, d: P.cell_issues(
        P.with_parsed(cells(s, d).filter(P.has_value())), P.type_faults(), codes=codes).select(*ISSUE)


def duplicate_ids(s, d):
    _, ready = context(s, d)
    return P.duplicate_issues(records(s, d), ready.facts).select("record_id", "n_copies", "offending_value", "description")


def file_names(s, d):
    ctx, ready = context(s, d)
    deleting = validate.by_intention(records(s, d), ctx.submissions)[1]
    return P.file_name_issues(deleting, ready.facts).select(*ISSUE)


def effective_vocabulary(s, d):
    return context(s, d)[1].rules.select(
        "node_type", "prop",
        F.when(F.col("pvs").isNull(), 0).otherwise(F.size("pvs")).cast("bigint").alias("n_entries"),
        "cde_missing", "concept_cde", F.array_join("pvs", ",").alias("entries"),
    )


def permitted_values(s, d):
    rows = P.with_terms(named(s, d), context(s, d)[1].index)
    return P.cell_issues(rows, P.vocabulary_faults()).select(
        "record_id", "offending_property", "offending_value", "description"
    )


def corrected_values(s, d):
    ctx, ready = context(s, d)
    matched, lists = validate.matched_cells(records(s, d), ctx, ready)
    return P.corrections(matched, lists).select("record_id", "prop", "new_value")


def recommendations(s, d):
    ctx, ready = context(s, d)
    matched, lists = validate.matched_cells(records(s, d), ctx, ready)
    # Not a filter: it would go down to the cells with the text of each number written out at every place, too long to be compiled.
    advised = F.col("looked_up") & F.col("entry").isNull() & F.col("advice").isNotNull()
    found = F.when(advised, F.array(F.struct("prop", "shown", "advice")))
    one = matched.withColumn("_found", found).select("record_id", F.inline(F.coalesce("_found", F.array())))
    many = lists.select("record_id", "prop", F.inline("items")).filter(
        F.col("entry").isNull() & F.col("advice").isNotNull()
    ).select("record_id", "prop", "shown", "advice")
    return one.unionByName(many).withColumnsRenamed({"prop": "offending_property", "shown": "offending_value"})


def list_values(s, d):
    return P.list_issues(validate.list_cells(records(s, d), *context(s, d))).select(
        "record_id", "offending_property", "offending_value", "description"
    )


def concept_codes(s, d):
    return P.concept_codes_of(cells(s, d), star.concept_codes(s, d)).select("record_id", "prop", "value")


def judged(s, d):
    ctx, _ = context(s, d)
    return R.judged_edges(records(s, d), ctx.model_nodes, ctx.model_props, ctx.model_rels)


def no_parents(s, d):
    ctx, _ = context(s, d)
    related = R.relation_rules(ctx.model_nodes, ctx.model_props, ctx.model_rels)[0]
    return R.missing_parents(records(s, d), related).select(*ISSUE)


def several_parents(s, d):
    ctx, _ = context(s, d)
    return R.several_parents(records(s, d), ctx.model_nodes, ctx.model_props, ctx.model_rels).select(
        "record_id", "code", "parent_type", "description"
    )


def absent_parents(s, d):
    ctx, _ = context(s, d)
    return R.absent_parent_issues(R.sound_edges(judged(s, d)), records(s, d), ctx.releases).select(
        "record_id", "pos", "parent_type", "parent_id_value", "description"
    )


def one_to_one(s, d):
    ctx, _ = context(s, d)
    return R.one_to_one_issues(R.sound_edges(judged(s, d)), records(s, d), ctx.releases, ctx.model_rels).select(
        "record_id", "pos", "parent_type", "parent_id_value", "n_children", "description"
    )


def reach(s, d):
    ctx, _ = context(s, d)
    files = ctx.model_nodes.filter("is_file").select("data_commons", "model_version", "node_type")
    return R.consent_reach(records(s, d), ctx.releases, files, "nation")


def consent(s, d):
    coded = validate.consent_codes(records(s, d), context(s, d)[0])
    return coded.select("record_id", "conflict", F.array_join("codes", ",").alias("codes"))


def _release(code):
    def query(s, d):
        ctx, ready = context(s, d)
        checked, deleting = validate.by_intention(records(s, d), ctx.submissions)
        if code == "M018":
            found = validate.changed_releases(checked, ctx, ready)
        else:
            found = X.release_issues(deleting, ctx.releases, ctx.submissions, ready.facts)
        return found.filter(F.col("code") == code).select(*ISSUE)

    return query


def pardoned(s, d):
    ctx, ready = context(s, d)
    checked, _ = validate.by_intention(records(s, d), ctx.submissions)
    related = R.relation_rules(ctx.model_nodes, ctx.model_props, ctx.model_rels)[0]
    # The issues are few and read three times, all cells are looked at for them.
    raised = stage(P.cell_issues(
        P.cells(checked, ready.rules, ready.facts), P.required_faults(), codes=["M003"], keep=validate.RAISED_KEYS
    ).unionByName(R.missing_parents(checked, related)), "issues")
    return X.without_pardoned(raised, records(s, d), ctx.releases, ctx.submissions).select(*ISSUE)


def cross_submission(s, d):
    found = X.cross_submission_issues(records(s, d), context(s, d)[0].submissions)
    return found.select("record_id", "n_submissions", F.col("offending_value").alias("others"))


def cross_members(s, d):
    return X.cross_members(records(s, d), context(s, d)[0].submissions).select(
        "study_id", "node_type", "node_id", "submission_id"
    )


def checked(s, d):
    """The result of one full check, made once per session and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _CHECKED:
        ctx, ready = context(s, d)
        _CHECKED[key] = validate.metadata_check(records(s, d), ctx, ready)
    return _CHECKED[key]


def all_issues(s, d):
    return checked(s, d).issues


def entries(column):
    """A map as sorted text."""
    shown = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<null>"))))
    return F.array_join(F.array_sort(shown), "~")


def as_text(rows):
    """Validated records with their maps and lists as text."""
    return rows.select(
        "record_id", "status", "issue_id", entries("props").alias("props"), entries("generated_props").alias("generated"),
        F.array_join("consent_codes", ",").alias("codes"))


def validated_records(s, d):
    ctx, _ = context(s, d)
    return as_text(checked(s, d).written_back(ctx, F.lit("2024-05-06").cast("timestamp")))


def statuses(s, d):
    return roll.record_status(records(s, d), all_issues(s, d))


def submission_states(s, d):
    given = context(s, d)[0].submissions.select("submission_id", "given_status")
    return roll.submission_status(statuses(s, d), given).select("submission_id", "status", "n_errors", "n_warnings")


QUERIES = {
    "a02_records_by_scope": lambda s, d: scans.by_scope(records(s, d), ["S1", "S3"], "New").select(
        "submission_id", "node_type", "node_id", "record_id"),
    "a03_records_by_type": lambda s, d: scans.by_type(records(s, d), "S2", "order").select(
        "submission_id", "node_id", "record_id"),
    "d01_invalid_nodes": lambda s, d: P.record_issues(records(s, d), context(s, d)[1].facts, ["M021", "M035"]).select(*ISSUE),
    "d02_blank_key": lambda s, d: P.record_issues(records(s, d), context(s, d)[1].facts, ["M022"]).select(*ISSUE),
    "d03_duplicate_ids": duplicate_ids,
    "d03_duplicate_members": lambda s, d: P.duplicate_members(records(s, d)).select(
        "submission_id", "node_type", "node_id", "record_id", "n_copies"),
    "d04_undefined_properties": _required("M017"),
    "d05_required_blank": _required("M003"),
    "d05b_delete_file_name": file_names,
    "d06_required_deleted": _required("M033"),
    "d07_registered_names": lambda s, d: P.cell_issues(named(s, d), P.name_faults()).select(*ISSUE),
    "d08_unknown_types": _typed("M009"),
    "d09_patterns": _typed("M031", "M032"),
    "d10_effective_vocabulary": effective_vocabulary,
    "d10_missing_elements": _typed("M027"),
    "d11_permitted_values": permitted_values,
    "d11_corrected_values": corrected_values,
    "d12_recommendations": recommendations,
    "d13_integers": _typed("M004"),
    "d14_numbers": _typed("M005"),
    "d15_bounds": _typed("M011", "M012"),
    "d16_dates": _typed("M007"),
    "d17_booleans": _typed("M008"),
    "d18_list_values": list_values,
    "d19_concept_codes": concept_codes,
    "e01_no_parents": no_parents,
    "e02_edge_rules": lambda s, d: R.edge_rule_issues(judged(s, d)).select("record_id", "pos", "broken"),
    "e03_several_parents": several_parents,
    "e04_absent_parents": absent_parents,
    "e05_one_to_one": one_to_one,
    "e05_children": lambda s, d: R.one_to_one_children(records(s, d), context(s, d)[0].releases, context(s, d)[0].model_rels).select(
        "submission_id", "parent_type", "parent_id_prop", "parent_id_value", "node_type", "node_id"),
    "e06_consent_groups": lambda s, d: reach(s, d).select("submission_id", "record_id", "group_id"),
    "e07_consent_codes": consent,
    "f01_changed_releases": _release("M018"),
    "f02_nothing_to_delete": _release("M019"),
    "f03_pardoned_issues": pardoned,
    "f04_cross_submission": cross_submission,
    "f04_cross_members": cross_members,
    "metadata_issues": lambda s, d: all_issues(s, d).select(*ISSUE),
    "validated_records": validated_records,
    "g01_record_status": lambda s, d: statuses(s, d).select("record_id", "status", "n_errors", "n_warnings"),
    "g03_submission_status": submission_states,
    "g05_qc_rows": lambda s, d: roll.qc_rows(records(s, d), all_issues(s, d)).select(
        "record_id", "severity", "n_errors", "n_warnings", "origin"),
    "g06_run_result": lambda s, d: roll.run_result(statuses(s, d), context(s, d)[0].submissions),
}
