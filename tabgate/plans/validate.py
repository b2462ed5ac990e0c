"""The metadata check as one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.functions.faults import ISSUE_KEYS
from tabgate.operators import properties, relations, release_checks, rules
from tabgate.operators.release_checks import DELETE
from tabgate.session import stage, stage_all

RAISED_KEYS = (*ISSUE_KEYS, "data_commons")
ISSUE_COLUMNS = (*ISSUE_KEYS, "code", "severity", "title", "offending_property", "offending_value", "description")


@dataclass
class Context:
    """Everything a check looks things up in."""

    submissions: DataFrame
    studies: DataFrame
    organizations: DataFrame
    model_nodes: DataFrame
    model_props: DataFrame
    model_rels: DataFrame
    cde: DataFrame
    synonyms: DataFrame
    releases: DataFrame
    program_prop: str = "program_name"
    study_prop: str = "study_name"
    consent_type: str | None = None  # node type of consent groups, and its property with their number
    consent_prop: str = "consent_group_number"
    concept_codes: DataFrame | None = None  # cde_code, pv, concept_code


def by_intention(records: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to check in full, records of submissions that delete)."""
    deleting = submissions.filter(F.col("intention") == DELETE).select("submission_id")
    return (
        records.join(deleting, "submission_id", "left_anti"),
        records.join(deleting, "submission_id", "left_semi"),
    )


class Prepared:
    """Rule tables of one run, each made when it is first asked for: effective rules, the term index,
    the registered names and the facts of node types are stored, so that the planner knows their size. It takes that of the facts
    for more than some 10 MB of records otherwise, sends the records to all tasks and lets one task, that of the facts, do all."""

    def __init__(self, ctx: Context) -> None:
        self._ctx = ctx

    @cached_property
    def rules(self) -> DataFrame:
        return stage(rules.effective_rules(rules.with_pattern_state(self._ctx.model_props), self._ctx.cde), "rules")

    @cached_property
    def index(self) -> DataFrame:
        return stage(rules.term_index(self.rules, self._ctx.synonyms), "terms")

    @cached_property
    def facts(self) -> DataFrame:
        return stage(properties.node_facts(self._ctx.model_nodes, self._ctx.model_props), "node-facts")

    @cached_property
    def names(self) -> DataFrame:
        ctx = self._ctx
        return stage(properties.submission_names(ctx.submissions, ctx.studies, ctx.organizations), "names")


def prepare(ctx: Context) -> Prepared:
    return Prepared(ctx)


def matched_cells(records: DataFrame, ctx: Context, ready: Prepared) -> tuple[DataFrame, DataFrame]:
    """All cells with rule, registered name and vocabulary match; and the list cells."""
    named = named_cells(records, ctx, ready)
    return properties.with_terms(properties.with_parsed(named), ready.index), list_cells(records, ctx, ready)


def named_cells(records: DataFrame, ctx: Context, ready: Prepared) -> DataFrame:
    long = properties.cells(records, ready.rules, ready.facts)
    return properties.named_cells(long, ready.names, ctx.program_prop, ctx.study_prop)


def list_cells(records: DataFrame, ctx: Context, ready: Prepared) -> DataFrame:
    return properties.list_terms(named_cells(properties.with_lists(records, ready.rules), ctx, ready), ready.index)


def consent_codes(records: DataFrame, ctx: Context, among: DataFrame | None = None) -> DataFrame:
    """The consent codes of file records, and whether they contradict each other."""
    files = ctx.model_nodes.filter("is_file").select("data_commons", "model_version", "node_type")
    return relations.file_consent_codes(records, ctx.releases, files, ctx.consent_type, ctx.consent_prop, among)


@dataclass
class Checked:
    """What a metadata check found: issues, the cells it looked at, the values it rewrites, and consent codes by record (if
    there are any)."""

    records: DataFrame
    issues: DataFrame
    cells: DataFrame
    fixes: DataFrame
    consent: DataFrame | None

    def written_back(self, ctx: Context, now: Column) -> DataFrame:
        """The records as the check leaves them."""
        generated = properties.concept_codes_of(self.cells, ctx.concept_codes)
        codes = self.consent
        if codes is None:
            codes = self.records.sparkSession.createDataFrame([], "record_id STRING, codes ARRAY<STRING>")
        return properties.written_back(self.records, self.issues, self.fixes, generated, codes, now)


def metadata_check(
    records: DataFrame, ctx: Context, ready: Prepared | None = None, among: DataFrame | None = None
) -> Checked:
    """A metadata check of ``records``, whose copies, parents and siblings are looked for ``among`` all records (by default
    the same), after the rules of intention and release.

    Cells are made where they are read, and never stored: they take more room and time than all that is found in them.
    Stored are the issues, made by all checks in one job so that small ones don't wait for each other, and the corrections.
    """
    ready = ready or prepare(ctx)
    checked, deleting = by_intention(records, ctx.submissions)
    around = checked if among is None else by_intention(among, ctx.submissions)[0]
    matched, lists = matched_cells(checked, ctx, ready)
    parts = [
        *properties.property_issue_parts(checked, ready.facts, matched, lists, around),
        *relations.relation_issue_parts(checked, ctx.releases, ctx.model_nodes, ctx.model_props, ctx.model_rels, around),
        properties.file_name_issues(deleting, ready.facts, RAISED_KEYS),
    ]
    consent = None
    if ctx.consent_type:
        consent = stage(consent_codes(checked, ctx, around), "consent")
        parts.append(relations.consent_issues(checked, consent))
    # Parts with issues that a release pardons carry the data commons of the record.
    shaped = [part.select(*[c for c in (*ISSUE_COLUMNS, "data_commons") if c in part.columns]) for part in parts]
    raised = stage(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shaped), "issues")
    kept = release_checks.without_pardoned(raised, records, ctx.releases, ctx.submissions)
    fixes = stage(properties.corrections(matched, lists), "fixes")
    changed = release_checks.release_issues(records, ctx.releases, ctx.submissions, ready.facts, fixes)
    issues = stage_all([kept.select(*ISSUE_COLUMNS), changed.select(*ISSUE_COLUMNS)], "issues")
    return Checked(records, issues, properties.cells(checked, ready.rules, ready.facts), fixes, consent)


def metadata_issues(records: DataFrame, ctx: Context, ready: Prepared | None = None) -> DataFrame:
    """All issues of a metadata check."""
    return metadata_check(records, ctx, ready).issues


def changed_releases(records: DataFrame, ctx: Context, ready: Prepared) -> DataFrame:
    """F1, F2 of ``records`` alone: corrections are worked out for the records that are compared, no others."""
    rows = stage(release_checks.compared(records, ctx.releases, ctx.submissions), "compared")
    fixes = properties.corrections(*matched_cells(rows, ctx, ready))
    return release_checks.compared_issues(properties.corrected_records(rows, fixes), ready.facts)
