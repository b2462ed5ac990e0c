"""Checks of file structure.

Input rows: batch_id, file_name, line_number, cells. The first row of a file is its header. Checks
have ranks; some stop the file. All are computed set-wise, and issues beyond the first stopping
rank of a file are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabgate.functions.ids import composite_id, file_id_ok
from tabgate.operators.lookup import attach, counted
from tabgate.operators.release_checks import DELETE
from tabgate.session import stage

FILE = ["batch_id", "file_name"]
FILE_LIMIT, BATCH_LIMIT = 100, 1000
MODEL = ("data_commons", "model_version")

# kind: (rank, stops the file)
RANKS = {
    "no_rows": (1, True), "extra_cells": (2, False), "empty_column": (2, False), "repeated_header": (3, False),
    "empty_row": (4, True), "no_type_column": (5, True), "no_type": (6, True), "unknown_type": (7, True),
    "other_type": (8, True), "no_key_column": (9, True), "no_component_column": (10, True),
    "no_components": (10, True), "no_key": (11, True), "bad_file_id": (12, True), "required_column": (13, False),
    "no_relationships": (14, False), "relationships_missing": (14, False), "unknown_parent": (14, False),
    "undefined_relationship": (14, False), "wrong_parent_key": (14, False), "duplicate": (15, True),
    "conflict": (15, True), "no_file_name_column": (16, True), "no_file_name": (16, True),
}
ONLY_FIRST = ("other_type", "no_component_column", "no_components")

# Message texts; %1$s file, %2$s line, %3$s and %4$s what the check is about.
TEXTS = {
    "no_rows": '“%1$s": no metadata in the file.',
    "extra_cells": '“%1$s: line %2$s": extra columns/cells found.',
    "empty_column": '“%1$s": empty column(s) found.',
    "repeated_header": '“%1$s": multiple columns with the same header ("%3$s") is not allowed.',
    "empty_row": '“%1$s: line %2$s": empty row found.',
    "no_type_column": "“%1$s”: “type” column is required.",
    "no_type": '“%1$s: line %2$s": “type” value is required.',
    "unknown_type": '“%1$s: %2$s": Node type “%3$s” is not defined.',
    "other_type": '“%1$s: %2$s": Node type “%3$s” is different from "%4$s", only one node type is allowed.',
    "no_key_column": "“%1$s”: Key property “%3$s” is required.",
    "no_component_column": '“%1$s”: Column "%3$s" is required to generate composite ID.',
    "no_components": "“%1$s:%2$s”: all properties (%3$s) needed for composite ID are missing.",
    "no_key": "“%1$s:%2$s”:  Key property “%3$s” value is required.",
    "bad_file_id": '“%1$s:line %2$s”: "%3$s" is not in correct format for file ID (property %4$s).',
    "required_column": "“%1$s”: %3$s required.",
    "no_relationships": '“%1$s”: Relationship column "%3$s" is invalid, "%4$s" node should not have any relationship columns.',
    "relationships_missing": "“%1$s”: All relationship columns are missing. Please ensure at least one relationship column is included.",
    "unknown_parent": '“%1$s”: Related node "%3$s" is not defined.',
    "undefined_relationship": '“%1$s”: Relationship to "%3$s" node is not defined.',
    "wrong_parent_key": '“%1$s”: "%3$s" is not Key property of "%4$s", please use the key property instead.',
    "duplicate": "“%1$s:%2$s”: duplicated data detected: “%4$s”: %3$s.",
    "conflict": '“%1$s: %2$s”: conflict data detected: “%3$s”: "%4$s".',
    "no_file_name_column": '“%1$s”: Property "%3$s" is required.',
    "no_file_name": "“%1$s:%2$s”:  file name property “%3$s” value is required.",
}


# --- B1 ----------------------------------------------------------------------------------------


def batch_issues(batches: DataFrame, submissions: DataFrame, model_nodes: DataFrame) -> DataFrame:
    """B1: the first reason a batch cannot be processed (batches without one are left out).

    ``batches``: batch_id, submission_id, type, files ARRAY<STRING>.
    """
    models = model_nodes.select(*MODEL).distinct().withColumn("has_model", F.lit(True))
    joined = batches.join(
        submissions.select("submission_id", *MODEL), "submission_id", "left"
    ).join(models, list(MODEL), "left")
    reason = (
        F.when(F.coalesce(F.col("type") != "metadata", F.lit(True)), "invalid batch type, only metadata allowed")
        .when(F.coalesce(F.size("files"), F.lit(0)) <= 0, "invalid batch, no files found")
        .when(F.size(metadata_files(F.col("files"))) == 0, "invalid batch, no metadata files found")
        .when(F.col("data_commons").isNull(), "invalid batch, no data commons found")
        .when(F.col("has_model").isNull(), "model version is not available")
    )
    return joined.select("batch_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def metadata_files(names: Column) -> Column:
    return F.filter(names, lambda n: F.lower(n).endswith(".tsv") | F.lower(n).endswith(".txt"))


# --- the sheet ---------------------------------------------------------------------------------


def unnamed(header: Column) -> Column:
    return F.coalesce((header == "") | header.contains("Unnamed:"), F.lit(True))


def cell(name: Column) -> Column:
    """The row's value in the named column; null when the file has no such column."""
    at = F.array_position(F.col("header"), name)
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def has_column(name: Column) -> Column:
    return F.coalesce(F.array_contains("header", name), F.lit(False))


def sheet(lines: DataFrame, batches: DataFrame, model_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rows): per file its header, counts, first type and model facts; rows with those facts.

    ``batches``: batch_id, submission_id, intention, omit_prefix and the model columns. Every file
    is reduced to one row with partial aggregates; rows of very large files are spread when the
    facts are joined back.
    """
    heads = lines.groupBy(*FILE).agg(
        F.min_by("cells", "line_number").alias("header"), F.min("line_number").alias("header_line"),
        F.count(F.lit(1)).alias("n_lines"),
    ).withColumn("header", F.transform("header", lambda h: F.coalesce(h, F.lit(""))))
    void = F.forall("cells", lambda c: c.isNull())
    body = attach(lines, heads, FILE, "n_lines", spread_by=["line_number"]).filter(
        F.col("line_number") > F.col("header_line")
    )
    per_file = body.groupBy(*FILE).agg(
        F.max(F.when(~void, F.col("line_number"))).alias("last_line"),
        F.min(F.struct("line_number", cell(F.lit("type")).alias("type"))).alias("first_row"),
    )
    files = stage(
        heads.join(per_file, FILE, "left")
        .withColumn("node_type", F.col("first_row.type")).drop("first_row")
        .join(batches, "batch_id")
        .join(
            model_nodes.select(
                *MODEL, "node_type", "id_prop", "comp_key", "is_file", "name_field", "size_field", "md5_field",
                F.lit(True).alias("known")
            ),
            [*MODEL, "node_type"], "left",
        ),
        "files",
    )
    facts = files.drop(*MODEL, "submission_id")
    rows = attach(lines, facts, FILE, "n_lines", spread_by=["line_number"]).filter(
        (F.col("line_number") > F.col("header_line")) & (F.col("line_number") <= F.col("last_line"))
    )
    return files, stage(rows.withColumn("empty", void), "sheet")


def _issue(kind: str, when: Column, line: Column | None = None, what=None, other=None, order=0) -> Column:
    rank, stops = RANKS[kind]
    as_text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lit(stops).alias("stops"),
            (line if line is not None else F.lit(0)).cast("int").alias("line_number"),
            F.lit(order).cast("int").alias("pos") if isinstance(order, int) else order.cast("int").alias("pos"),
            as_text(what).alias("what"), as_text(other).alias("other"),
        ),
    )


def _emit(df: DataFrame, *issues: Column) -> DataFrame:
    return df.select(*FILE, F.inline(F.filter(F.array(*issues), lambda i: i.isNotNull())))


# --- checks ------------------------------------------------------------------------------------


def file_checks(files: DataFrame) -> DataFrame:
    """B2, B5, B7-B9 and B16 as far as the header alone tells."""
    repeated = F.filter(
        F.array_distinct("header"),
        lambda h: ~unnamed(h) & (F.size(F.filter("header", lambda o: o == h)) > 1),
    )
    has_type, deleting = has_column(F.lit("type")), F.col("intention") == DELETE
    typed = has_type & F.col("node_type").isNotNull()
    one = _emit(
        files,
        _issue("no_rows", F.col("last_line").isNull()),
        _issue("no_type_column", ~has_type),
        _issue("unknown_type", typed & F.col("known").isNull(), F.lit(2), F.col("node_type")),
        _issue("no_key_column", F.col("known") & F.col("id_prop").isNotNull() & ~has_column(F.col("id_prop")),
               what=F.col("id_prop")),
        _issue("no_file_name_column", deleting & F.col("is_file") & ~has_column(F.col("name_field")),
               what=F.col("name_field")),
    )
    twice = _emit(
        files.select(*FILE, F.posexplode(repeated).alias("at", "name")),
        _issue("repeated_header", F.lit(True), what=F.col("name"), order=F.col("at")),
    )
    return one.unionByName(twice)


def blank_columns(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns without a header. Trailing ones without values do not count at all."""
    blanks = files.select(*FILE, F.posexplode("header").alias("at", "name")).filter(unnamed(F.col("name")))
    filled = rows.select(
        *FILE, "line_number", F.posexplode(F.transform("header", unnamed)).alias("at", "blank"), "cells"
    ).filter(F.col("blank") & F.get("cells", F.col("at")).isNotNull()).select(*FILE, "line_number", "at")
    counts = counted(filled, [*FILE, "at"], name="n_filled")
    known = blanks.join(counts, [*FILE, "at"], "left")
    kept_to = files.select(*FILE, F.posexplode("header").alias("at", "name")).join(
        known.select(*FILE, "at", F.col("n_filled").isNull().alias("void")), [*FILE, "at"], "left"
    ).groupBy(*FILE).agg(F.max(F.when(~F.coalesce("void", F.lit(False)), F.col("at"))).alias("last_at"))
    inner = known.join(kept_to, FILE).filter(F.col("at") <= F.col("last_at"))
    first_void = inner.filter(F.col("n_filled").isNull()).groupBy(*FILE).agg(F.min("at").alias("void_at"))
    void = _emit(first_void, _issue("empty_column", F.lit(True), order=F.col("void_at")))
    extra = filled.join(first_void, FILE, "left").filter(
        F.col("void_at").isNull() | (F.col("at") < F.col("void_at"))
    )
    return void.unionByName(
        _emit(extra, _issue("extra_cells", F.lit(True), F.col("line_number"), order=F.col("at")))
    )


def row_checks(rows: DataFrame) -> DataFrame:
    """B6-B11 and B16 on rows: one narrow pass."""
    line, kind = F.col("line_number"), cell(F.lit("type"))
    key = cell(F.col("id_prop"))
    has_key = F.col("known") & has_column(F.col("id_prop"))
    state = F.transform(
        "comp_key",
        lambda c: F.when(~has_column(c), F.concat(F.lit("-"), c)).when(cell(c).isNotNull(), F.lit("+")),
    )
    first_state = F.get(F.filter(state, lambda s: s.isNotNull()), F.lit(0))
    composite = F.coalesce(F.size("comp_key") > 0, F.lit(False))
    lost = has_key & composite & key.isNull()
    named = F.col("is_file") & has_key & key.isNotNull()
    deleting = F.col("intention") == DELETE
    name = cell(F.col("name_field"))
    found = _emit(
        rows,
        _issue("empty_row", F.col("empty"), line),
        _issue("no_type", has_column(F.lit("type")) & kind.isNull(), line),
        _issue("other_type", kind != F.col("node_type"), line, kind, F.col("node_type")),
        _issue("no_component_column", lost & first_state.startswith("-"), line, F.substring(first_state, 2, 1 << 20)),
        _issue("no_components", lost & first_state.isNull(), line, F.array_join("comp_key", ", ")),
        _issue("no_key", has_key & ~composite & key.isNull(), line, F.col("id_prop")),
        _issue("bad_file_id", named & ~file_id_ok(key, F.coalesce("omit_prefix", F.lit(False))), line, key,
               F.col("id_prop")),
        _issue("no_file_name", deleting & F.col("is_file") & has_column(F.col("name_field")) & name.isNull(), line,
               F.col("name_field")),
    )
    many = found.filter(~F.col("kind").isin(*ONLY_FIRST))
    rest = [c for c in found.columns if c not in (*FILE, "line_number", "rank")]
    single = found.filter(F.col("kind").isin(*ONLY_FIRST)).groupBy(*FILE, "rank").agg(
        F.min(F.struct("line_number", *rest)).alias("one")
    ).select(*[F.col(f"one.{c}").alias(c) if c in (*rest, "line_number") else F.col(c) for c in found.columns])
    return many.unionByName(single)


def column_checks(files: DataFrame, model_props: DataFrame, model_rels: DataFrame, model_nodes: DataFrame) -> DataFrame:
    """Required columns and relationship columns, from the headers."""
    usable = files.filter(F.col("known") & (F.coalesce("intention", F.lit("")) != DELETE))
    needed = model_props.filter("required").select(*MODEL, "node_type", "prop")
    absent = (
        usable.join(needed, [*MODEL, "node_type"])
        .filter((F.col("prop") != F.col("id_prop")) & ~F.array_contains("header", F.col("prop")))
        .groupBy(*FILE).agg(F.array_sort(F.collect_list("prop")).alias("props"))
        .withColumn(
            "props",
            F.when(F.size("props") == 1, F.format_string('Property "%s" is', F.get("props", F.lit(0))))
            .otherwise(F.format_string("Properties %s are", F.to_json("props"))),
        )
    )
    required = _emit(absent, _issue("required_column", F.lit(True), what=F.col("props")))

    rels = model_rels.select(*MODEL, "node_type", "parent_type", F.lit(True).alias("defined"))
    related = model_rels.select(*MODEL, "node_type").distinct().withColumn("has_rels", F.lit(True))
    parents = model_nodes.select(
        *MODEL, F.col("node_type").alias("parent_type"), F.col("id_prop").alias("parent_key")
    ).withColumn("parent_known", F.lit(True))
    with_rels = usable.join(related, [*MODEL, "node_type"], "left").withColumn("rel_columns", relation_columns())
    missing = _emit(
        with_rels, _issue("relationships_missing", F.col("has_rels") & (F.size("rel_columns") == 0))
    )
    columns = (
        with_rels.select(*FILE, *MODEL, "node_type", "has_rels", F.posexplode("rel_columns").alias("at", "column"))
        .withColumn("parent_type", F.get(F.split("column", r"\."), F.lit(0)))
        .withColumn("parent_prop", F.get(F.split("column", r"\."), F.lit(1)))
        .join(parents, [*MODEL, "parent_type"], "left")
        .join(rels, [*MODEL, "node_type", "parent_type"], "left")
    )
    judged = columns.withColumn(
        "step",
        F.when(F.col("has_rels").isNull(), 1).when(F.col("parent_known").isNull(), 2)
        .when(F.col("defined").isNull(), 3).when(F.col("parent_prop") != F.col("parent_key"), 4),
    ).filter(F.col("step").isNotNull())
    # Only the first failing kind of a file is reported, and of wrong keys only the first column.
    first = judged.groupBy(*FILE).agg(F.min(F.struct("step", "at")).alias("lead"))
    shown = judged.join(first, FILE).filter(
        (F.col("step") == F.col("lead.step")) & ((F.col("step") < 4) | (F.col("at") == F.col("lead.at")))
    )
    at, step = F.col("at"), F.col("step")
    broken = _emit(
        shown,
        _issue("no_relationships", step == 1, what=F.col("column"), other=F.col("node_type"), order=at),
        _issue("unknown_parent", step == 2, what=F.col("parent_type"), order=at),
        _issue("undefined_relationship", step == 3, what=F.col("parent_type"), order=at),
        _issue("wrong_parent_key", step == 4, what=F.col("parent_prop"), other=F.col("parent_type"), order=at),
    )
    return required.unionByName(missing).unionByName(broken)


def relation_columns() -> Column:
    return F.filter("header", lambda h: h.contains(".") & ~h.rlike(r"\.\d*$"))


def repeat_checks(rows: DataFrame, bad_relations: DataFrame) -> DataFrame:
    """Rows of one file that share an id.

    Without (sound) relationship columns every such row is a duplicate. Otherwise the repeats must
    differ throughout in some relationship column, and agree in all others. Reporting ends with
    the first id that is a plain duplicate. Copies are counted, never paired.
    """
    flawed = bad_relations.select(*FILE).distinct().withColumn("flawed", F.lit(True))
    usable = rows.filter(F.col("known") & (F.coalesce("intention", F.lit("")) != DELETE))
    parts = F.transform(F.coalesce("comp_key", F.array().cast("array<string>")), cell)
    ident = usable.withColumn("row_id", composite_id(cell(F.col("id_prop")), parts)).withColumn(
        "rel_columns", relation_columns()
    )
    key = [*FILE, "row_id"]
    groups = counted(ident.select(*key), key, at_least=2, name="n_copies")
    repeats = stage(
        attach(ident, groups, key, "n_copies", spread_by=["line_number"]).filter(F.col("n_copies").isNotNull())
        .join(flawed, FILE, "left"),
        "repeats",
    )
    plain = F.coalesce("flawed", F.lit(False)) | (F.size("rel_columns") == 0)
    all_rows = _emit(
        repeats.filter(plain),
        _issue("duplicate", F.lit(True), F.col("line_number"), F.col("row_id"), F.col("id_prop")),
    )
    linked = repeats.filter(~plain)
    long = linked.select(
        *key, "line_number", "n_copies", "rel_columns", F.posexplode("header").alias("at", "column"), "cells", "id_prop"
    ).filter((F.col("column") != "type") & (F.col("column") != F.col("id_prop"))).withColumn(
        "is_rel", F.array_contains("rel_columns", F.col("column"))
    ).withColumn("value", F.get("cells", F.col("at")))
    distinct_values = long.groupBy(*key, "at", "column", "is_rel", "value").agg(
        F.min("line_number").alias("line_number"), F.max("n_copies").alias("n_copies")
    )
    per_column = distinct_values.groupBy(*key, "at", "column", "is_rel").agg(
        F.count(F.lit(1)).alias("n_values"), F.max("n_copies").alias("n_copies")
    )
    verdict = per_column.groupBy(*key).agg(
        F.max(F.col("is_rel") & (F.col("n_values") == F.col("n_copies"))).alias("is_m2m"),
        F.min(F.when(~F.col("is_rel") & (F.col("n_values") > 1), F.col("at"))).alias("conflict_at"),
    )
    # An id comes up where its second row stands; the first plain duplicate ends the file's report.
    first_lines = linked.groupBy(*key).agg(
        F.min("line_number").alias("first_line"), F.max("n_copies").alias("n_copies")
    )
    second = (
        attach(linked.select(*key, "line_number"), first_lines, key, "n_copies", spread_by=["line_number"])
        .filter(F.col("line_number") > F.col("first_line"))
        .groupBy(*key).agg(F.min("line_number").alias("turn"))
    )
    judged = stage(verdict.join(second, key).join(first_lines, key), "judged")
    ends = judged.filter(~F.col("is_m2m")).groupBy(*FILE).agg(F.min("turn").alias("end"))
    reported = judged.join(ends, FILE, "left").filter(F.col("end").isNull() | (F.col("turn") <= F.col("end")))
    copies = reported.filter(~F.col("is_m2m"))
    duplicate_rows = _emit(
        attach(linked.select(*key, "line_number", "id_prop"), copies.select(*key, "n_copies", "turn"), key, "n_copies",
               spread_by=["line_number"]).filter(F.col("turn").isNotNull()),
        _issue("duplicate", F.lit(True), F.col("line_number"), F.col("row_id"), F.col("id_prop")),
    )
    clashes = distinct_values.join(
        reported.filter(F.col("is_m2m") & F.col("conflict_at").isNotNull()).select(*key, F.col("conflict_at").alias("at")),
        [*key, "at"],
    )
    conflicts = _emit(
        clashes, _issue("conflict", F.lit(True), F.col("line_number"), F.col("column"), F.col("value"), F.col("at"))
    )
    return all_rows.unionByName(duplicate_rows).unionByName(conflicts)


def structure_issues(
    lines: DataFrame, batches: DataFrame, model_nodes: DataFrame, model_props: DataFrame, model_rels: DataFrame,
    file_limit: int | None = None, batch_limit: int | None = None,
) -> DataFrame:
    """batch_id, file_name, kind, line_number, what, other, text; all issues unless limits are given."""
    files, rows = sheet(lines, batches, model_nodes)
    return capped(issues_of(files, rows, model_nodes, model_props, model_rels), file_limit, batch_limit)


def issues_of(
    files: DataFrame, rows: DataFrame, model_nodes: DataFrame, model_props: DataFrame, model_rels: DataFrame
) -> DataFrame:
    """All issues of a sheet up to the first stopping rank of each file."""
    columns = stage(column_checks(files, model_props, model_rels, model_nodes), "columns")
    bad_relations = columns.filter(F.col("rank") == RANKS["unknown_parent"][0])
    parts = [
        file_checks(files), blank_columns(files, rows), row_checks(rows), columns, repeat_checks(rows, bad_relations),
    ]
    found = stage(reduce(DataFrame.unionByName, parts), "structure")
    ends = found.filter("stops").groupBy(*FILE).agg(
        F.min("rank").alias("end"), F.count(F.lit(1)).alias("n_issues")
    )
    kept = attach(found, ends, FILE, "n_issues", spread_by=["line_number", "kind"]).filter(
        F.col("end").isNull() | (F.col("rank") <= F.col("end"))
    ).drop("end", "n_issues")
    return kept.withColumn("text", _text())


def _text() -> Column:
    pick = None
    for kind, template in TEXTS.items():
        shown = F.format_string(
            template, F.col("file_name"), F.col("line_number"), F.coalesce("what", F.lit("nan")),
            F.coalesce("other", F.lit("nan")),
        )
        matches = F.col("kind") == kind
        pick = F.when(matches, shown) if pick is None else pick.when(matches, shown)
    return pick


def capped(issues: DataFrame, file_limit: int | None = FILE_LIMIT, batch_limit: int | None = BATCH_LIMIT) -> DataFrame:
    """The report shows the first issues of a file and of a batch.

    Spark keeps at most the limit per group before it shuffles, so a file full of faults stays cheap.
    """
    order = ["rank", "line_number", "pos", "kind", "what"]
    if file_limit:
        issues = issues.withColumn(
            "_nth", F.row_number().over(Window.partitionBy(*FILE).orderBy(*order))
        ).filter(F.col("_nth") <= file_limit).drop("_nth")
    if batch_limit:
        issues = issues.withColumn(
            "_nth", F.row_number().over(Window.partitionBy("batch_id").orderBy("file_name", *order))
        ).filter(F.col("_nth") <= batch_limit).drop("_nth")
    return issues


def failed_batches(issues: DataFrame) -> DataFrame:
    """One bad file fails the whole batch."""
    return issues.select("batch_id").distinct()
