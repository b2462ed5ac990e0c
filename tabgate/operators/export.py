"""Exports: rows per node type, counts, summary, file manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgate.functions.ids import with_file_prefix
from tabgate.functions.text import size_text
from tabgate.operators.lookup import attach, counted
from tabgate.operators.release_checks import NEW_UPDATE
from tabgate.session import stage

NODE = ["data_commons", "node_type", "node_id"]
GLOBAL_ID_COLUMN = "global_id"
METADATA_ONLY = "Metadata Only"
OPEN_CODE = "-1"


def _nothing() -> Column:
    return F.create_map().cast("map<string,string>")


def _generated() -> Column:
    return F.coalesce("generated_props", _nothing())


def _parent_columns() -> Column:
    """One column per parent type, named after the first of its id properties, with its ids joined."""
    kinds = F.array_distinct(F.col("parents.parent_type"))

    def of_type(kind: Column) -> Column:
        same = F.filter("parents", lambda p: p["parent_type"] == kind)
        return F.struct(
            F.concat(kind, F.lit("."), F.get(same, F.lit(0))["parent_id_prop"]).alias("key"),
            F.array_join(F.transform(same, lambda p: p["parent_id_value"]), " | ").alias("value"),
        )

    # Most records have one parent of a type, so there is nothing to search for or to join.
    each = F.transform("parents", lambda p: F.struct(
        F.concat(p["parent_type"], F.lit("."), p["parent_id_prop"]).alias("key"),
        F.coalesce(p["parent_id_value"], F.lit("")).alias("value"),
    ))
    single = F.size(kinds) == F.size("parents")
    return F.map_from_entries(F.when(single, each).otherwise(F.transform(kinds, of_type)))


def export_rows(records: DataFrame, model_nodes: DataFrame) -> DataFrame:
    """Records with their exported ``columns`` as a map, built inside the row, and the ``names`` of these.

    Properties, type, global id of main nodes, generated properties and one column per parent type
    with its ids joined; a later source replaces an earlier one of the same name. What is used more than once is a column of
    its own: inside the function of a filter it would be worked out again for each property.
    """
    main = model_nodes.select("data_commons", "model_version", "node_type", "is_main")
    joined = records.join(main, ["data_commons", "model_version", "node_type"], "left")
    has_ident = F.coalesce("is_main", F.lit(False)) & F.col("global_id").isNotNull()
    rows = joined.withColumns({
        "_made": _generated(), "_up": _parent_columns(),
        "_ident": F.when(has_ident, F.create_map(F.lit(GLOBAL_ID_COLUMN), F.col("global_id"))).otherwise(_nothing()),
    }).withColumn(
        "_taken", F.concat(F.array(F.lit("type"), F.lit(GLOBAL_ID_COLUMN)), F.map_keys("_made"), F.map_keys("_up"))
    ).withColumn("_given", F.coalesce("props", _nothing()))
    # Few records have a property that something else replaces.
    own = F.when(
        F.arrays_overlap(F.map_keys("_given"), "_taken"),
        F.map_filter("_given", lambda k, v: ~F.array_contains("_taken", k)),
    ).otherwise(F.col("_given"))
    whole = F.map_concat(own, F.create_map(F.lit("type"), F.col("node_type")), "_ident", "_made", "_up")
    shown = F.transform_values(
        whole, lambda k, v: F.when(v == "True", "true").when(v == "False", "false").otherwise(v)
    )
    names = F.concat(
        F.array_except(F.map_keys("_given"), "_taken"), F.array(F.lit("type")), F.map_keys("_ident"), F.map_keys("_made"),
        F.map_keys("_up"),
    )
    return rows.withColumns({"columns": shown, "names": names}).drop(
        "is_main", "_made", "_up", "_ident", "_taken", "_given")


def column_order(rows: DataFrame, id_prop: str) -> list[str]:
    """Type first, key second, the others by name. Only the distinct names reach the driver; their
    number follows the model, not the data."""
    names = [r[0] for r in rows.select(F.explode(F.map_keys("columns")).alias("c")).distinct().collect()]
    rest = sorted(n for n in names if n not in ("type", id_prop))
    return ["type", *([id_prop] if id_prop in names else []), *rest]


def export_table(rows: DataFrame, node_type: str, id_prop: str) -> DataFrame:
    """The wide table of one node type; every column is looked up in the row's own map."""
    mine = rows.filter(F.col("node_type") == node_type)
    order = column_order(mine, id_prop)
    return mine.select(*[F.try_element_at("columns", F.lit(c)).alias(c) for c in order])


def column_orders(rows: DataFrame, model_nodes: DataFrame) -> DataFrame:
    """J2 (node_type, order) of all types: type first, key second, the others by name. One row per type, as long as the
    model has columns for it. ``rows``: node_type, names ARRAY<STRING>."""
    names = rows.select("node_type", F.explode("names").alias("name")).distinct()
    keys = model_nodes.groupBy("node_type").agg(F.min("id_prop").alias("id_prop"))
    listed = names.groupBy("node_type").agg(F.sort_array(F.collect_list("name")).alias("names")).join(keys, "node_type", "left")
    key = F.filter(F.array("id_prop"), lambda k: F.coalesce(F.array_contains("names", k), F.lit(False)))
    rest = F.filter("names", lambda n: (n != "type") & ~F.array_contains(key, n))
    return listed.select("node_type", F.concat(F.array(F.lit("type")), key, rest).alias("order"))


def tsv_line(cells: Column) -> Column:
    """Cells as a line: null as nothing, quotes around what holds a tab, a quote or a line end."""
    odd = '[\t\n\r"]'

    def shown(cell: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(cell.rlike(odd), quoted).otherwise(cell), F.lit(""))

    # Few rows hold any of these, so a row is searched whole before its cells are.
    return F.when(
        F.array_join(cells, "").rlike(odd), F.array_join(F.transform(cells, shown), "\t")
    ).otherwise(F.array_join(cells, "\t", ""))


def write_tables(rows: DataFrame, model_nodes: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> None:
    """The tab-separated tables of all node types in one job, below ``folder``/node_type=<type>/file=<n>, each file with
    the header of its type.

    Rows are dealt over as many files as their type needs, and a header joins each; nothing about the data reaches the
    driver. Within a file the header stands first and the rows follow by their text.
    """
    typed = rows.filter(F.coalesce("node_type", F.lit("")) != "")
    # Rows of a type have few different lists of columns, so one pass leaves a few rows, from which names and numbers follow.
    # It needs no cells if the rows come with their names.
    names = F.col("names") if "names" in rows.columns else F.map_keys("columns")
    shapes = stage(
        typed.groupBy("node_type", names.alias("names")).agg(F.count(F.lit(1)).alias("n")), "export-shapes"
    )
    counts = shapes.groupBy("node_type").agg(F.sum("n").alias("n"))
    # Stored, so that the planner knows how small it is and doesn't move all rows of a type to one task.
    heads = stage(column_orders(shapes, model_nodes).join(counts, "node_type").withColumn(
        "n_files", F.ceil(F.col("n") / F.lit(rows_per_file)).cast("int")
    ), "export-heads")
    listed = typed.select("node_type", "columns").join(heads.select("node_type", "order", "n_files"), "node_type").select(
        "node_type", "n_files", F.transform("order", lambda c: F.try_element_at("columns", c)).alias("cells"),
    )
    lines = listed.select(
        "node_type", F.lit(1).alias("part"), "n_files", tsv_line(F.col("cells")).alias("value")
    ).select("node_type", F.pmod(F.xxhash64("value"), F.col("n_files")).cast("int").alias("file"), "part", "value")
    headers = heads.select(
        "node_type", F.explode(F.sequence(F.lit(0), F.col("n_files") - 1)).alias("file"), F.lit(0).alias("part"),
        tsv_line(F.col("order")).alias("value"),
    )
    every = lines.unionByName(headers).repartition("node_type", "file")
    every.sortWithinPartitions("node_type", "file", "part", "value").select("node_type", "file", "value").write.mode(
        "overwrite").partitionBy("node_type", "file").text(folder)


def read_table(spark: SparkSession, folder: str, node_type: str) -> DataFrame:
    """One type's table as it was written."""
    reader = spark.read.option("sep", "\t").option("header", "true").option("escape", '"').option("multiLine", "true")
    path = f"{folder}/node_type={node_type}"
    # All files of a type have the same header, and there always is a first one.
    return reader.schema(reader.csv(f"{path}/file=0").schema).option("recursiveFileLookup", "true").csv(path)


def with_presence(records: DataFrame, releases: DataFrame) -> DataFrame:
    weights = counted(records, NODE, name="n_rows")
    known = releases.select(*NODE).distinct().join(weights, NODE).withColumn("is_released", F.lit(True))
    return attach(records, known, NODE, "n_rows", spread_by=["record_id"]).drop("n_rows")


def export_counts(records: DataFrame, releases: DataFrame, submissions: DataFrame) -> DataFrame:
    """Per submission and type: total, and new / update by presence among the releases; for any
    other intention everything counts as deleted."""
    rows = with_presence(records, releases).join(submissions.select("submission_id", "intention"), "submission_id")
    merging = F.coalesce(F.col("intention") == NEW_UPDATE, F.lit(False))
    known = F.coalesce("is_released", F.lit(False))
    return rows.groupBy("submission_id", "node_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(merging & ~known).alias("new"),
        F.count_if(merging & known).alias("update"), F.count_if(~merging).alias("delete"),
    )


def data_file_totals(records: DataFrame, submissions: DataFrame) -> DataFrame:
    """Number and size of the data files of a submission."""
    wanted = submissions.filter(F.col("data_type") != METADATA_ONLY).select("submission_id")
    files = records.filter(F.col("file_info").isNotNull()).join(wanted, "submission_id", "left_semi")
    sums = files.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("file_info.size"), F.lit(0)).alias("total_size")
    )
    return sums.withColumn("size_text", size_text(F.col("total_size")))


def release_summary(submissions: DataFrame, counts: DataFrame, totals: DataFrame, studies: DataFrame) -> DataFrame:
    """One JSON text per submission. A model has few node types, so the count list is short."""
    per_type = counts.groupBy("submission_id").agg(
        F.array_sort(F.collect_list(F.struct("node_type", "total", "new", "update", "delete"))).alias("counts")
    )
    joined = (
        submissions.join(studies, "study_id", "left").join(per_type, "submission_id")
        .join(totals, "submission_id", "left")
    )
    files = F.transform("counts", lambda c: F.concat("submission_id", F.lit("-"), c["node_type"], F.lit(".tsv")))
    body = F.struct(
        F.col("submission_id").alias("submission ID"),
        F.struct(F.col("study_name").alias("name"), F.col("dbgap_id").alias("dbGaPID")).alias("study"),
        F.col("model_version").alias("data model version"), F.col("intention"),
        F.col("data_type").alias("submission type"),
        F.struct(F.size("counts").alias("number of metadata files"), files.alias("metadata files")).alias("metadata files"),
        F.col("counts").alias("metadata record counts"),
        F.when(
            F.col("data_type") != METADATA_ONLY,
            F.struct(
                F.coalesce("n_files", F.lit(0)).alias("count"), F.coalesce("size_text", F.lit("0B")).alias("total size")
            ),
        ).alias("data files"),
    )
    return joined.select("submission_id", F.to_json(body).alias("summary"))


def file_manifest(records: DataFrame, submissions: DataFrame, bucket: str) -> DataFrame:
    """Guid, md5, size, acl, authz, urls of every data file.

    Open data is open to all. Controlled data lists one entry per consent code, or the accession
    alone; a controlled submission without accession gets no manifest.
    """
    subs = submissions.select("submission_id", "controlled_access", "dbgap_id", F.col("study_id").alias("_study"))
    joined = records.filter(F.col("file_info").isNotNull()).join(subs, "submission_id")
    controlled = F.coalesce("controlled_access", F.lit(False))
    rows = joined.filter(~controlled | (F.coalesce("dbgap_id", F.lit("")) != ""))
    accession = F.substring_index("dbgap_id", ".", 1)
    codes = F.coalesce("consent_codes", F.array().cast("array<string>"))

    def listed(open_text: str, lead: str) -> Column:
        items = F.transform(
            codes,
            lambda c: F.when(c == OPEN_CODE, F.lit(f'"{open_text}"')).otherwise(
                F.concat(F.lit(f'"{lead}'), accession, F.lit(".c"), c, F.lit('"'))
            ),
        )
        alone = F.concat(F.lit(f'["{lead}'), accession, F.lit('"]'))
        return (
            F.when(~controlled, F.lit(f"['{open_text}']"))
            .when(F.size(codes) > 0, F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))
            .otherwise(alone)
        )

    return rows.select(
        "submission_id", with_file_prefix(F.col("node_id")).alias("guid"), F.col("file_info.md5").alias("md5"),
        F.col("file_info.size").alias("size"), listed("*", "").alias("acl"), listed("/open", "/programs/").alias("authz"),
        F.concat(F.lit(f"s3://{bucket}/"), "_study", F.lit("/"), "file_info.file_name").alias("urls"),
    )
