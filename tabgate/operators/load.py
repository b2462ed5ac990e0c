"""Turning sound sheet rows into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.functions.ids import composite_id, file_id_case, stable_file_id, uuid5, with_file_prefix
from tabgate.functions.text import strip
from tabgate.messages import NEW
from tabgate.operators.lookup import attach
from tabgate.operators.structure import cell
from tabgate.schema import EDGE

# Columns with a meaning of their own, and the node type identified by ORCID.
INTERNAL_NAME = "internal_file_name"
INVESTIGATOR = "principal_investigator"
RECORD_NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"
FILE_KEY = ["batch_id", "file_name", "node_id"]
NODE_KEY = ["submission_id", "node_type", "node_id"]


LAYOUT = ("prop_names", "prop_at", "raw_names", "raw_at", "relations", "inner_at", "name_at", "size_at", "md5_at")


def with_layout(files: DataFrame) -> DataFrame:
    """Where everything stands in the rows of a file, worked out once per file from its header.

    Of columns with one name the first counts. Names with a dot are relationships.
    """
    named = F.filter(
        F.transform("header", lambda h, at: F.struct(h.alias("name"), at.alias("at"))),
        lambda e: (e["name"] != "") & (F.array_position("header", e["name"]) == e["at"] + 1),
    )
    files = files.withColumn("_named", named)
    plain = F.filter(
        "_named", lambda e: ~e["name"].contains(".") & (e["name"] != "type") & (e["name"] != INTERNAL_NAME)
        & ~(e["name"].eqNullSafe(F.when(_id_written(), F.col("id_prop"))))
    )
    relations = F.transform(
        F.filter("_named", lambda e: e["name"].contains(".")),
        lambda e: F.struct(
            F.get(F.split(e["name"], r"\."), F.lit(0)).alias("parent_type"),
            F.get(F.split(e["name"], r"\."), F.lit(1)).alias("parent_id_prop"), e["at"].alias("at"),
        ),
    )

    def place(name: Column) -> Column:
        at = F.array_position("header", name)
        return F.when(at > 0, (at - 1).cast("int"))

    return files.withColumns(
        {
            "prop_names": F.transform(plain, lambda e: e["name"]), "prop_at": F.transform(plain, lambda e: e["at"]),
            "raw_names": F.transform("_named", lambda e: e["name"]), "raw_at": F.transform("_named", lambda e: e["at"]),
            "relations": relations, "inner_at": place(F.lit(INTERNAL_NAME)), "name_at": place(F.col("name_field")),
            "size_at": place(F.col("size_field")), "md5_at": place(F.col("md5_field")),
        }
    ).drop("_named")


def _id_written() -> Column:
    """The id goes back into the key property of file nodes and of rows whose id may be composed."""
    return F.coalesce("is_file", F.lit(False)) | F.coalesce(F.size("comp_key") > 0, F.lit(False))


def values_at(places: Column) -> Column:
    return F.transform(places, lambda at: F.get("cells", at))


def node_id() -> Column:
    """C1, C2."""
    parts = F.transform(F.coalesce("comp_key", F.array().cast("array<string>")), cell)
    has_parts = F.coalesce(F.size("comp_key") > 0, F.lit(False))
    key = cell(F.col("id_prop"))
    ident = F.when(has_parts, composite_id(key, parts)).otherwise(F.nullif(strip(key), F.lit("")))
    return F.when(F.coalesce("is_file", F.lit(False)), file_id_case(ident)).otherwise(ident)


def parents_of_row() -> Column:
    """One edge per item of every filled relationship cell, in column order."""

    def of_cell(r: Column) -> Column:
        value = F.get("cells", r["at"])
        items = F.when(value.contains("|"), F.transform(F.split(value, r"\|"), strip)).otherwise(F.array(value))
        return F.transform(
            items,
            lambda v: F.struct(
                r["parent_type"].alias("parent_type"), r["parent_id_prop"].alias("parent_id_prop"),
                v.alias("parent_id_value"),
            ),
        )

    filled = F.filter("relations", lambda r: F.coalesce(F.get("cells", r["at"]) != "", F.lit(False)))
    return F.flatten(F.transform(filled, of_cell)).cast(f"array<{EDGE}>")


def row_records(rows: DataFrame) -> DataFrame:
    """One candidate record per sheet row; no shuffle.

    ``rows``: batch_id, file_name, line_number, cells, header, the model facts of the file's type and
    its layout (see with_layout).
    """
    base = rows.withColumn("node_id", node_id())
    plain = F.map_from_arrays("prop_names", values_at(F.col("prop_at")))
    props = F.when(
        _id_written(), F.map_concat(plain, F.map_from_arrays(F.array("id_prop"), F.array("node_id")))
    ).otherwise(plain)
    return base.select(
        "batch_id", "file_name", "line_number", "node_type", "node_id", "id_prop", props.alias("props"),
        parents_of_row().alias("parents"),
        F.map_from_arrays("raw_names", values_at(F.col("raw_at"))).alias("raw_data"), file_info().alias("file_info"),
    )


def file_info() -> Column:
    """Name from the internal name column when it is filled, else from the model's name field."""
    name = F.coalesce(F.nullif(F.get("cells", F.col("inner_at")), F.lit("")), F.get("cells", F.col("name_at")))
    return F.when(
        F.coalesce("is_file", F.lit(False)),
        F.struct(
            name.alias("file_name"), F.get("cells", F.col("size_at")).try_cast("bigint").alias("size"),
            F.get("cells", F.col("md5_at")).alias("md5"), F.lit(NEW).alias("status"),
        ),
    )


def pick_one(rows: DataFrame, key: list[str], order: str, last: bool) -> DataFrame:
    """One row per key, the first or last by ``order``, any of them if several are. Rows that are alone under their key are
    not grouped; of the others only the best are, and the partial aggregates keep one per task. Columns that nobody reads
    don't travel."""
    best = (F.max if last else F.min)(order).alias("_best")
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), best).filter(F.col("_n") >= 2)
    marked = attach(rows, groups, key, "_n", spread_by=[order])
    alone = marked.filter(F.col("_n").isNull()).select(*rows.columns)
    several = marked.filter(F.col("_n").isNotNull() & F.col(order).eqNullSafe(F.col("_best")))
    return alone.unionByName(several.select(*rows.columns).dropDuplicates(key))


def merged_edges(rows: DataFrame) -> DataFrame:
    """C5 as a long table: distinct parents of every id of a file, with their first place."""
    long = rows.select(*FILE_KEY, "line_number", F.posexplode("parents").alias("at", "edge"))
    return long.groupBy(*FILE_KEY, "edge").agg(F.min(F.struct("line_number", "at")).alias("first"))


def merged(rows: DataFrame) -> DataFrame:
    """Rows of one id in one file become one record: the first row's content, all parents.

    Parents are made distinct before any list is built, so copies never pile up; the list of one
    record is as long as its own distinct parents.
    """
    groups = rows.groupBy(*FILE_KEY).agg(
        F.count(F.lit(1)).alias("n_copies"), F.min("line_number").alias("_first")
    ).filter(F.col("n_copies") >= 2)
    marked = attach(rows, groups, FILE_KEY, "n_copies", spread_by=["line_number"])
    alone = marked.filter(F.col("n_copies").isNull()).select(*rows.columns)
    repeats = marked.filter(F.col("n_copies").isNotNull())
    firsts = repeats.filter(F.col("line_number").eqNullSafe(F.col("_first"))).select(*rows.columns).dropDuplicates(FILE_KEY)
    lists = merged_edges(repeats).groupBy(*FILE_KEY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first", "edge"))), lambda s: s["edge"]
        ).cast(f"array<{EDGE}>").alias("_parents")
    )
    joined = firsts.join(lists, FILE_KEY, "left").withColumn("parents", F.coalesce("_parents", "parents"))
    return alone.unionByName(joined.select(*rows.columns))


def one_per_node(candidates: DataFrame) -> DataFrame:
    """The same id in several files of a batch: the last file by name wins."""
    return pick_one(candidates, NODE_KEY, "file_name", last=True)


def with_stored(candidates: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Keeps record id, creation time, global id and batches of the stored record.

    A new record gets a name-based id of its key, so a repeated attempt yields the same id.
    """
    known = stored.groupBy(*NODE_KEY).agg(
        F.min(F.struct("record_id", "created_at", "global_id", "batch_ids")).alias("old")
    )
    fresh = uuid5(F.lit(RECORD_NAMESPACE), F.concat_ws("|", *NODE_KEY))
    joined = candidates.join(known, NODE_KEY, "left")
    batches = F.concat(F.coalesce("old.batch_ids", F.array().cast("array<string>")), F.array("batch_id"))
    return joined.select(
        *candidates.columns,
        F.coalesce("old.record_id", fresh).alias("record_id"),
        F.coalesce("old.created_at", now).alias("created_at"),
        F.array_distinct(batches).alias("batch_ids"),
        F.col("old.global_id").alias("stored_global_id"),
        F.col("old").isNotNull().alias("was_stored"),
        F.lit(NEW).alias("status"), now.alias("updated_at"), now.alias("uploaded_date"),
    )


def with_global_id(records: DataFrame, stored: DataFrame, releases: DataFrame, submissions: DataFrame) -> DataFrame:
    """C7. ``records``: was_stored, stored_global_id, is_main, is_file, data_commons, study_id, entity_type.

    Order: stored record; released node; any record of the node outside submissions whose release
    was deleted; any record of the same study, entity and id; a new name-based id. Lookups have
    one row per key.
    """
    node = ["data_commons", "node_type", "node_id"]
    live = releases.filter(F.coalesce(F.col("status") != "Deleted", F.lit(True))).groupBy(*node).agg(
        F.min("global_id").alias("live_id"), F.lit(True).alias("is_live")
    )
    gone = releases.filter(F.col("status") == "Deleted").select(*node, "submission_id").distinct()
    others = stored.join(gone, [*node, "submission_id"], "left_anti").groupBy(*node).agg(
        F.min("global_id").alias("other_id")
    )
    entity = ["study_id", "entity_type", "node_id"]
    kin = stored.filter(F.col("entity_type").isNotNull()).groupBy(*entity).agg(F.min("global_id").alias("kin_id"))
    orcid = submissions.select("submission_id", "orcid")
    joined = (
        records.join(live, node, "left").join(others, node, "left").join(kin, entity, "left")
        .join(orcid, "submission_id", "left")
    )
    fresh = uuid5(F.lit(RECORD_NAMESPACE), F.concat_ws("|", F.lit("global"), *node))
    found = F.when(F.col("is_live"), F.col("live_id")).otherwise(F.col("other_id"))
    general = F.when(F.col("was_stored"), F.col("stored_global_id")).otherwise(F.coalesce(found, "kin_id", fresh))
    source = (
        F.when(F.col("was_stored"), "stored").when(F.col("is_live") & F.col("live_id").isNotNull(), "release")
        .when(found.isNotNull(), "record").when(F.col("kin_id").isNotNull(), "study").otherwise("new")
    )
    value = (
        F.when(~F.col("is_main"), F.lit(None))
        .when(F.col("node_type") == INVESTIGATOR, F.col("orcid"))
        .when(F.col("is_file"), with_file_prefix(F.col("node_id")))
        .otherwise(general)
    )
    return joined.select(
        *records.columns, value.alias("global_id"),
        F.when(F.col("is_main") & ~F.col("is_file") & (F.col("node_type") != INVESTIGATOR), source).alias("id_source"),
    )


def file_id_report(files: DataFrame, site: str, has_prefix: bool = True) -> DataFrame:
    """Files whose node id, id property or global id is not the stable id of their path.

    ``files``: record_id, study_id, file_name, node_id, file_id, global_id.
    """
    right = stable_file_id(site, F.col("study_id"), F.col("file_name"))
    own = right if has_prefix else F.substring_index(right, "/", -1)
    checked = files.withColumn("right_global_id", right).withColumn("right_id", own)
    wrong = (
        ~F.col("global_id").eqNullSafe(F.col("right_global_id")) | ~F.col("node_id").eqNullSafe(F.col("right_id"))
        | ~F.col("file_id").eqNullSafe(F.col("right_id"))
    )
    return checked.filter(wrong)


