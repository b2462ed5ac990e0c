"""Queries over the driver tables: data files, deletion, release, export, vocabulary, repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabgate.operators import backfill as N
from tabgate.operators import delete as I
from tabgate.operators import export as O
from tabgate.operators import files as H
from tabgate.operators import issues as roll
from tabgate.operators import release as J
from tabgate.operators import vocabulary as L
from tabgate.operators.versions import VersionedTable
from tabgate.plans import check_queries, file_tables, star
from tabgate.schema import EDGES, HISTORY, RELEASES
from tabgate.session import scratch_path, stage
from tabgate.sources import records as scans

NOW = "2024-05-06 07:08:09"
_STORED: dict = {}


def _once(s, d, name, make):
    key = (s.sparkContext.applicationId, d, name)
    if key not in _STORED:
        _STORED[key] = stage(make(), name)
    return _STORED[key]


# --- data files --------------------------------------------------------------------------------


def file_issues(s, d):
    listing = file_tables.listing(s, d).select("submission_id", "file_name", "actual_size", "actual_md5")
    return H.file_issues(file_tables.files(s, d), listing)


def same_content(s, d):
    rows = H.same_content(file_tables.files(s, d))
    return rows.select(
        "submission_id", "file_name", "md5", "n_same", F.coalesce("n_sums", F.lit(1)).alias("n_sums"),
        F.coalesce("n_names", F.lit(1)).alias("n_names"))


def checksum_plan(s, d):
    good, todo = H.reusable_checksums(
        file_tables.listing(s, d).select("submission_id", "file_name", "path", "modified_at"), file_tables.cache(s, d))
    return good.select("path", "md5").unionByName(todo.select("path", F.lit("to hash").alias("md5")))


def orphans(s, d):
    return H.orphans(file_tables.listing(s, d), file_tables.files(s, d), file_tables.upload_batches(s, d)).select(
        "submission_id", "file_name", "batch_id", "code")


def file_status(s, d):
    return H.submission_file_status(file_tables.files(s, d), file_issues(s, d), orphans(s, d))


# --- deletion ----------------------------------------------------------------------------------


def one_submission(s, d):
    return check_queries.records(s, d).withColumn("submission_id", F.lit("S0"))


def wanted_ids(s, d):
    star.tables(s, d, "nation")
    return s.sql("SELECT CAST(n_nationkey * 5 AS STRING) AS node_id FROM nation")


def cascaded(s, d):
    rows = one_submission(s, d)
    start = I.chosen(rows, "S0", "nation", wanted_ids(s, d))
    return I.cascade(rows, start)


def cascade(s, d):
    shown = F.array_join(F.array_sort(F.transform("parents", lambda p: F.concat(
        p["parent_type"], F.lit("="), p["parent_id_value"]))), ",")
    return cascaded(s, d).select("record_id", "node_type", "node_id", "action", shown.alias("parents_left"))


def files_removed(s, d):
    rows = file_tables.file_records(s, d)
    gone = rows.filter(F.col("record_id").endswith("3")).select("record_id", F.lit("deleted").alias("action"))
    return I.files_to_remove(rows, gone)


def status_after(s, d):
    left = file_tables.files(s, d).filter(F.col("submission_id") != "S3").select(
        "submission_id", F.when(F.col("doc_id") % 500 == 1, "Error").otherwise("Passed").alias("status"),
        (F.col("submission_id") == "S1").alias("has_file"))
    given = star.stored_submissions(s, d).select("submission_id", "given_status")
    return I.status_after(left, given, file_tables.listing(s, d).filter(F.col("submission_id") != "S2"))


# --- release -----------------------------------------------------------------------------------


def all_to_release(s, d):
    """The records of all types, some of their properties blank or to be cleared."""
    key = F.col("node_id").try_cast("bigint")
    return check_queries.records(s, d).withColumns({
        "props": F.when(key % 14 == 0, F.transform_values("props", lambda k, v: F.when(
            k.isin("segment", "urgent"), " ").when(k == "totalprice", "<Delete>").otherwise(v))).otherwise(F.col("props")),
        "global_id": F.concat(F.lit("G:"), "node_id"),
        "generated_props": F.create_map(F.lit("flag"), F.when(key % 2 == 0, "True").otherwise("False")),
        "file_info": F.struct(F.concat(F.lit("f"), "node_id").alias("file_name")),
    })


def to_release(s, d):
    return all_to_release(s, d).filter(F.col("node_type").isin("customer", "order"))


def old_releases(s, d):
    rows = check_queries.context(s, d)[0].releases
    key = F.col("node_id").cast("bigint")
    moved = F.transform("parents", lambda p: F.struct(
        p["parent_type"].alias("parent_type"), p["parent_id_prop"].alias("parent_id_prop"),
        F.concat(p["parent_id_value"], F.lit("9")).alias("parent_id_value")))
    parents = F.when(key % 21 == 0, moved).when(key % 9 == 0, F.array().cast(EDGES)).otherwise(F.col("parents"))
    entry = F.array(F.struct(F.lit("S?"), F.lit("New/Update"), F.lit(NOW).cast("timestamp"), F.col("props"), F.col("parents")))
    return rows.withColumns({
        "parents": parents.cast(EDGES), "generated_props": F.lit(None).cast("map<string,string>"),
        "data_file_location": F.lit(None).cast("string"), "created_at": F.lit("2020-01-01").cast("timestamp"),
        "updated_at": F.lit(None).cast("timestamp"),
        "history": F.when(key % 2 == 0, entry.cast(HISTORY)).otherwise(F.array().cast(HISTORY)),
    })


def released(s, d):
    def make():
        subs = star.stored_submissions(s, d).withColumn("file_bucket", F.lit("dm"))
        return J.release_records(
            to_release(s, d), old_releases(s, d), subs, star.model_rels(s), F.lit(NOW).cast("timestamp"))

    return _once(s, d, "released", make)


def release_changes(s, d):
    return released(s, d).select("node_type", "node_id", "change", "status", "submission_id")


def release_props(s, d):
    return released(s, d).filter("change <> 'delete'").select("node_type", "node_id", F.explode("props").alias("prop", "value"))


def release_parents(s, d):
    return released(s, d).filter("change <> 'delete' AND node_type = 'order'").select(
        "node_id", F.array_join(F.transform("parents", lambda p: p["parent_id_value"]), ",").alias("parents"))


def release_history(s, d):
    first, last = F.get("history", F.lit(0)), F.element_at("history", -1)
    return released(s, d).filter("change <> 'delete'").select(
        "node_type", "node_id", F.size("history").cast("bigint").alias("n_entries"),
        first["submission_id"].alias("first_submission"), last["submission_id"].alias("last_submission"),
        last["intention"].alias("last_intention"))


def file_urls(s, d):
    return released(s, d).filter("change = 'insert'").select("node_type", "node_id", "data_file_location")


def below_deleted(s, d):
    rel = check_queries.context(s, d)[0].releases
    gone = rel.filter((F.col("node_type") == "nation") & (F.col("node_id").try_cast("bigint") % 5 == 0))
    return J.below_deleted(rel, gone).select("node_type", "node_id")


def _released_table(s, d):
    """The table of releases after the submission that deletes was released, and after the others were: two versions."""
    table = VersionedTable(s, scratch_path(s, "releases"), RELEASES, "node_id", buckets=8)
    gaps = {"generated_props": "map<string,string>", "data_file_location": "string", "created_at": "timestamp",
            "updated_at": "timestamp", "history": HISTORY}
    old = check_queries.context(s, d)[0].releases.withColumns({c: F.lit(None).cast(kind) for c, kind in gaps.items()})
    table.upsert(old, J.NODE)
    subs = star.stored_submissions(s, d).withColumn("file_bucket", F.lit("dm"))
    rows, now = all_to_release(s, d), F.lit(NOW).cast("timestamp")
    deleting = F.col("submission_id") == "S7"
    for turn, part in enumerate((rows.filter(deleting), rows.filter(~deleting))):
        J.release_into(table, part, subs, star.model_rels(s), now, mark=("release", turn))
    return table


def released_table(s, d):
    table = _released_table(s, d)
    both = [table.read(v).withColumn("version", F.lit(v)) for v in (2, 3)]
    return both[0].unionByName(both[1]).select(
        "version", "node_type", "node_id", "status", "submission_id", F.coalesce(F.size("history"), F.lit(0)).cast("bigint").alias("n_history"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def retired(s, d):
    return J.files_to_retire(file_tables.file_records(s, d).withColumn(
        "submission_id", F.when(F.col("submission_id") == "S3", "S7").otherwise(F.col("submission_id"))), star.stored_submissions(s, d))


# --- export ------------------------------------------------------------------------------------


def exported(s, d):
    return O.export_rows(to_release(s, d), star.model_nodes(s))


def export_cells(s, d):
    return exported(s, d).select("record_id", F.explode("columns").alias("column", "value"))


def export_customers(s, d):
    return O.export_table(exported(s, d), "customer", "customer_id")


def _written(s, d):
    """The tables of all types as tab-separated text, in several files each, and their types."""
    def make():
        folder = scratch_path(s, "export")
        O.write_tables(O.export_rows(all_to_release(s, d), star.model_nodes(s)), star.model_nodes(s), folder, rows_per_file=5_000)
        return folder

    key = (s.sparkContext.applicationId, d, "written")
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def export_written(s, d):
    """The order table written as tab-separated text and read back."""
    back = O.read_table(s, _written(s, d), "order")
    return back.select("type", "order_id", "flag", "`customer.customer_id`").withColumnRenamed(
        "customer.customer_id", "customer")


def all_written(s, d):
    """All tables read back: how often each value stands in each column, and whether that is first, second (the key; a type
    that the model doesn't know has none) or later."""
    parts = []
    known = [n["node_type"] for n in star.model_node_rows()]
    for kind in [*known, "custmer"]:
        back = O.read_table(s, _written(s, d), kind)
        cells = F.array(*[
            F.struct(F.lit(at if at < 1 + (kind in known) else 2).alias("place"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for at, c in enumerate(back.columns)])
        parts.append(back.select(F.lit(kind).alias("node_type"), F.inline(cells)).filter("value IS NOT NULL"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("node_type", "column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").cast("bigint").alias("place"))


def counts(s, d):
    return O.export_counts(check_queries.records(s, d), check_queries.context(s, d)[0].releases, star.stored_submissions(s, d))


def file_totals(s, d):
    return O.data_file_totals(file_tables.file_records(s, d), star.stored_submissions(s, d))


def summary(s, d):
    totals = file_totals(s, d)
    text = O.release_summary(star.stored_submissions(s, d), counts(s, d), totals, star.studies(s, d))
    def part(path):
        return F.get_json_object("summary", path)

    return text.select(
        "submission_id", part("$.study.name").alias("study"), part("$.intention").alias("intention"),
        part("$['metadata files']['number of metadata files']").alias("n_tables"),
        part("$['metadata record counts'][0].total").alias("first_total"),
        part("$['data files']['total size']").alias("total_size"))


def manifest(s, d):
    return O.file_manifest(file_tables.file_records(s, d), star.stored_submissions(s, d), "prod")


# --- vocabulary --------------------------------------------------------------------------------


def elements(s, d):
    return L.elements(file_tables.dump(s, d), F.col("p_partkey"))


def dump_scan(s, d):
    """The dump as files that each hold one array, with line breaks around commas."""
    rows = file_tables.dump(s, d)
    entry = F.to_json(F.struct(*[c for c in rows.columns if c != "p_partkey"]))
    lines = rows.select(F.expr("p_partkey DIV 5000").alias("file_no"), "p_partkey", entry.alias("value"))
    first = Window.partitionBy("file_no").orderBy("p_partkey")
    last = F.lead("p_partkey").over(first).isNull()
    opened = F.when(F.lag("p_partkey").over(first).isNull(), "[ ").otherwise("  ")
    folder = scratch_path(s, "dump")
    lines.select("file_no", F.concat(opened, "value", F.when(last, "\n]").otherwise("\n,")).alias("value")).write.partitionBy(
        "file_no").text(folder)
    return L.read_dump(s, folder).select(
        "CDECode", "CDEVersion", "CDEFullName", F.inline("permissibleValues")
    ).withColumn("synonyms", F.array_join("synonyms", "~"))


def stored_elements(s, d):
    return elements(s, d).filter(F.col("code").endswith("1")).select(
        "code", "version", F.lit("old name").alias("full_name"), F.array(F.lit("old")).alias("pvs")).unionByName(
        elements(s, d).filter(F.col("code").endswith("2")).select(
            F.concat(F.lit("Z"), "code").alias("code"), "version", "full_name", "pvs"))


def element_rows(rows):
    return rows.withColumn("pvs", F.array_join("pvs", ","))


def upserted_elements(s, d):
    return element_rows(L.upserted_elements(stored_elements(s, d), elements(s, d)))


def appended_synonyms(s, d):
    first = elements(s, d)
    return L.appended(L.synonym_pairs(first.filter(F.col("code").endswith("1"))), L.synonym_pairs(first), ["synonym", "term"])


def appended_codes(s, d):
    first = elements(s, d)
    fields = ["cde_code", "pv", "concept_code"]
    return L.appended(L.concept_triples(first.filter(F.col("code").endswith("1"))), L.concept_triples(first), fields)


def restored_files(s, d):
    """A listing of stored files and of the folders they are in, as object stores give it."""
    star.tables(s, d, "documents")
    listed = s.sql("""SELECT 'file/' || source || '/' || CAST(doc_id AS STRING) || '.txt' AS path FROM documents
                      UNION ALL SELECT DISTINCT 'file/' || source || '/' FROM documents""")
    return J.files_to_restore(listed)


def rule_rows(s, d):
    return L.rule_rows(file_tables.definitions(s, d)).select(
        "model_version", "node_type", "prop", "type", "required", "min", "min_exclusive", "max", "max_exclusive", "pattern",
        F.array_join("pvs", ",").alias("pvs"))


def registered_terms(s, d):
    return L.rule_rows(file_tables.definitions(s, d)).filter("cde_code IS NOT NULL").select("prop", "cde_code", "cde_version")


def relation_rows(s, d):
    star.tables(s, d, "part", "lineitem")
    ends = s.sql("""
      SELECT 'DC' AS data_commons, '1' AS model_version, 'r' AS relation, 'n' || CAST(l_partkey % 200 AS STRING) AS source,
        'n' || CAST(l_suppkey % 50 AS STRING) AS target,
        CASE l_linenumber WHEN 1 THEN 'one_to_one' WHEN 2 THEN 'some_to_some' END AS own_multiplicity,
        CASE l_linenumber WHEN 3 THEN 'many_to_many' WHEN 4 THEN 'odd' END AS relation_multiplicity,
        l_orderkey * 1000000 + CAST(l_extendedprice AS BIGINT) AS position FROM lineitem WHERE l_partkey % 200 < 190""")
    nodes = s.sql("SELECT DISTINCT 'DC' AS data_commons, '1' AS model_version, 'n' || CAST(p_partkey % 180 AS STRING) AS node_type FROM part")
    return L.relation_rules(ends, nodes, "many_to_one").select("node_type", "parent_type", "multiplicity")


# --- repairs -----------------------------------------------------------------------------------


def order_rows(s, d):
    star.tables(s, d, "orders")
    return s.sql("""
      SELECT CAST(o_orderkey AS STRING) AS id, 'S' || CAST(o_custkey % 12 AS STRING) AS submission_id, 'T?' AS study_id,
        CASE o_orderkey % 6 WHEN 0 THEN 'program' WHEN 1 THEN 'case' WHEN 2 THEN 'specimen' WHEN 3 THEN 'data_file'
             WHEN 4 THEN 'pathology_file' ELSE 'other' END AS node_type, 'kept' AS entity_type,
        map('file_name', CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE 'a' || o_orderstatus END,
            'data_file_name', CASE WHEN o_orderkey % 10 <> 0 THEN 'b' END) AS props,
        CASE WHEN o_orderkey % 13 = 0 THEN 's3://there' END AS data_file_location,
        array(o_orderstatus, 'x') AS status,
        CASE o_orderkey % 4 WHEN 0 THEN 'New' WHEN 1 THEN 'Inquired' WHEN 2 THEN 'Approved' END AS state,
        CASE WHEN o_orderkey % 9 = 0 THEN '3.0' END AS version,
        array(named_struct('code', CASE WHEN o_orderkey % 8 = 7 THEN 'KEPT' END,
          'title', CASE o_orderkey % 7 WHEN 0 THEN 'Duplicate IDs' WHEN 1 THEN 'Value out of range' WHEN 2 THEN 'Internal error'
                                       WHEN 3 THEN 'Never heard of' ELSE 'Data file not found' END,
          'description', CASE o_orderkey % 3 WHEN 0 THEN 'x below y' WHEN 1 THEN 'x above y' ELSE 'Data file validation' END))
          AS errors
      FROM orders""")


def study_ids(s, d):
    return N.with_study(order_rows(s, d), star.stored_submissions(s, d)).select("id", "study_id")


def issue_codes(s, d):
    return N.with_codes(order_rows(s, d), "errors").select("id", F.get("errors", F.lit(0))["code"].alias("code"))


def id_structs(s, d):
    star.tables(s, d, "customer")
    rows = s.sql("SELECT CAST(c_custkey AS STRING) AS id, array(c_mktsegment, CAST(c_nationkey AS STRING)) AS studies FROM customer")
    return N.id_structs(rows, "studies").select("id", F.posexplode("studies").alias("pos", "e")).select("id", "pos", "e._id")


def file_locations(s, d):
    return N.with_file_location(order_rows(s, d), star.stored_submissions(s, d)).select("id", "data_file_location")


def versions(s, d):
    return N.with_version(order_rows(s, d).withColumn("status", F.col("state"))).select("id", "version")


def rendered(s, d):
    issues = check_queries.all_issues(s, d).select("record_id", "code", "offending_property")
    return issues.join(roll.catalog(s).select("code", "title", "severity"), "code").select(
        "record_id", "code", "title", "severity")


def runs(s, d):
    star.tables(s, d, "orders")
    rows = s.sql("""
      SELECT CAST(o_orderkey AS STRING) AS validation_id,
        CASE WHEN o_orderkey % 3 = 0 THEN array('metadata') ELSE array('metadata', 'file') END AS types,
        CASE o_orderkey % 5 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Failed' ELSE 'Passed' END AS status,
        o_orderdate AS ended,
        CASE o_orderkey % 4 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' ELSE 'Passed' END AS metadata_status,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS metadata_ended,
        CASE o_orderkey % 6 WHEN 0 THEN 'Warning' WHEN 1 THEN 'Error' ELSE 'Passed' END AS file_status,
        CASE WHEN o_orderkey % 11 <> 0 THEN CAST('1997-01-01' AS TIMESTAMP) END AS file_ended
      FROM orders""")
    return roll.combined_runs(rows).select(
        "validation_id", "status", F.date_format("ended", "yyyy-MM-dd").alias("ended"), "updated")


QUERIES = {
    "a04_file_records": lambda s, d: scans.with_files(file_tables.file_records(s, d)).select("submission_id", "record_id"),
    "a07_vocabulary_scan": dump_scan,
    "a08_rule_rows": rule_rows,
    "a08_relationship_rules": relation_rows,
    "a09_registered_terms": registered_terms,
    "g02_rendered_issues": rendered,
    "g04_combined_runs": runs,
    "h01_h04_file_issues": lambda s, d: file_issues(s, d).select(
        "record_id", "code", "severity", "offending_property", "offending_value", "description"),
    "h03_checksum_reuse": checksum_plan,
    "h04_same_content": same_content,
    "h05_orphans": orphans,
    "h06_file_status": file_status,
    "i01_ids_not_found": lambda s, d: I.not_found(one_submission(s, d), "S0", "nation", wanted_ids(s, d)),
    "i02_cascade": cascade,
    "i03_files_to_remove": files_removed,
    "i04_status_after_delete": status_after,
    "j01_j03_export_cells": export_cells,
    "j02_export_customers": export_customers,
    "j02_written_orders": export_written,
    "j02_all_written": all_written,
    "j04_export_counts": counts,
    "j05_file_totals": file_totals,
    "j06_release_summary": summary,
    "j07_file_manifest": manifest,
    "j08_release_changes": release_changes,
    "j09_release_properties": release_props,
    "j10_release_parents": release_parents,
    "j11_release_history": release_history,
    "j12_below_deleted": below_deleted,
    "j13_file_urls": file_urls,
    "released_table": released_table,
    "j14_files_to_retire": retired,
    "j14_files_to_restore": restored_files,
    "l01_l02_elements": lambda s, d: element_rows(elements(s, d).drop("raw")),
    "l03_synonyms": lambda s, d: L.synonym_pairs(elements(s, d)),
    "l04_concept_codes": lambda s, d: L.concept_triples(elements(s, d)),
    "l05_upserted_elements": upserted_elements,
    "l06_appended_synonyms": appended_synonyms,
    "l06_appended_concept_codes": appended_codes,
    "n01_study_ids": study_ids,
    "n02_entity_types": lambda s, d: N.with_entity(order_rows(s, d)).select("id", "entity_type"),
    "n03_issue_codes": issue_codes,
    "n04_first_status": lambda s, d: N.first_status(order_rows(s, d)).select("id", "status"),
    "n05_id_structs": id_structs,
    "n06_file_locations": file_locations,
    "n07_versions": versions,
}
