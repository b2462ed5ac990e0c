"""Expected results of file scans, structure checks, loading and stored-table upkeep."""

from __future__ import annotations

from oracle.base import cte, sql
from tabgate.plans import file_tables

cte("crows", """SELECT *, c_custkey // 50 AS f, CAST(c_custkey % 50 AS INTEGER) AS i, (c_custkey // 50) % 20 AS t,
                'C' || CAST((c_custkey // 50) % 4 AS VARCHAR) AS batch_id,
                'customers_' || CAST(c_custkey // 50 AS VARCHAR) || '.tsv' AS file_name FROM customer""")
cte("prows", """SELECT *, p_partkey // 50 AS f, CAST(p_partkey % 50 AS INTEGER) AS i, (p_partkey // 50) % 8 AS t,
                'P' || CAST((p_partkey // 50) % 8 AS VARCHAR) AS batch_id,
                'parts_' || CAST(p_partkey // 50 AS VARCHAR) || '.tsv' AS file_name FROM part""")


def rows(kind: str, where: str, line: str = "i + 2", what: str = "NULL", source: str = "crows") -> str:
    return (f"SELECT batch_id, file_name, '{kind}' AS kind, CAST({line} AS INTEGER) AS line_number,"
            f" CAST({what} AS VARCHAR) AS what FROM {source} WHERE {where}")


def once(kind: str, where: str, line: str = "0", what: str = "NULL", source: str = "crows") -> str:
    return rows(kind, f"i = 0 AND {where}", line, what, source)


B02 = once("no_rows", "t = 1")
B04 = f"{rows('extra_cells', 't = 2 AND i % 10 = 0')} UNION ALL {once('empty_column', 't = 18')}"
B05 = once("repeated_header", "t = 3", what="'name'")
B06 = rows("empty_row", "t = 4 AND i = 7")
B07 = f"{once('no_type_column', 't = 5')} UNION ALL {rows('no_type', 't = 6 AND i = 9')}"
galaxy, other = "'galaxy'", "'order'"
B08 = (once("unknown_type", "t = 7", "2", galaxy) + " UNION ALL " + rows("other_type", "t = 8 AND i = 3", what=other))
B09 = (once("no_key_column", "t = 9", what="'customer_id'") + " UNION ALL "
       + rows("no_key", "t = 10 AND i IN (5, 6)", what="'customer_id'"))
B10 = (rows("no_component_column", "t = 4 AND i = 6", what="'linenumber'", source="prows") + " UNION ALL "
       + rows("no_components", "t = 3 AND i = 4", what="'orderkey, linenumber'", source="prows"))
B11 = rows("bad_file_id", "t = 1 AND i % 7 = 0", what="'not-an-id'", source="prows")
B12 = once("required_column", "t = 11", what="'Property \"segment\" is'")
B13 = " UNION ALL ".join([
    once("relationships_missing", "t = 12"), once("unknown_parent", "t = 13", what="'galaxy'"),
    once("undefined_relationship", "t IN (14, 16)", what="'part'"), once("wrong_parent_key", "t = 15", what="'anthem'")])
B14 = " UNION ALL ".join([
    rows("duplicate", "t = 16", what="c_custkey // 2"), rows("duplicate", "t = 19 AND i < 2", what="c_custkey // 2"),
    rows("conflict", "t = 17", what="'name'")])
B16 = (rows("no_file_name", "t = 5 AND i % 9 = 0", what="'scan'", source="prows") + " UNION ALL "
       + once("no_file_name_column", "t = 6", what="'scan'", source="prows"))
ALL_B = " UNION ALL ".join([B02, B04, B05, B06, B07, B08, B09, B10, B11, B12, B13, B14, B16])
cte("bissues", ALL_B)

RANK = """CASE kind WHEN 'no_rows' THEN 1 WHEN 'extra_cells' THEN 2 WHEN 'empty_column' THEN 2 WHEN 'repeated_header' THEN 3
  WHEN 'empty_row' THEN 4 WHEN 'no_type_column' THEN 5 WHEN 'no_type' THEN 6 WHEN 'unknown_type' THEN 7
  WHEN 'other_type' THEN 8 WHEN 'no_key_column' THEN 9 WHEN 'no_component_column' THEN 10 WHEN 'no_components' THEN 10
  WHEN 'no_key' THEN 11 WHEN 'bad_file_id' THEN 12 WHEN 'required_column' THEN 13 WHEN 'duplicate' THEN 15
  WHEN 'conflict' THEN 15 WHEN 'no_file_name' THEN 16 WHEN 'no_file_name_column' THEN 16 ELSE 14 END"""

ORACLE = {
    "a01_tsv_scan": r"""
      SELECT c_custkey // 1000 AS file_no, 1 AS line_number, 'type~customer_id~name~segment' AS cells FROM customer
      WHERE c_custkey % 1000 = 0
      UNION ALL
      SELECT c_custkey // 1000, c_custkey % 1000 + 2, 'customer~' || CAST(c_custkey AS VARCHAR) || '~' ||
        CASE WHEN c_custkey % 11 = 0 THEN 'a' || chr(9) || 'b "q"' WHEN c_custkey % 13 = 0 THEN '<null>' ELSE c_name END ||
        '~' || c_mktsegment || CASE WHEN c_custkey % 997 = 5 THEN '~more' ELSE '' END FROM customer""",
    "a01b_unreadable_files": """
      SELECT 'file_' || CAST(k AS VARCHAR) AS file_name, CAST(NULL AS BIGINT) AS line_number, 'file not found' AS kind
      FROM (SELECT DISTINCT c_custkey // 500 AS k FROM customer)
      WHERE k NOT IN (SELECT c_custkey // 1000 FROM customer)
      UNION ALL
      SELECT 'file_' || CAST(c_custkey // 1000 AS VARCHAR), min(c_custkey % 1000 + 2), 'Expected 4 fields saw 5'
      FROM customer WHERE c_custkey % 997 = 5 GROUP BY c_custkey // 1000""",
    "a05_a06_listing_and_checksum": """
      SELECT doc_id // 100 AS bundle, CAST(sum(strlen(text) + 1) AS BIGINT) AS size,
             md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS md5
      FROM documents GROUP BY doc_id // 100""",
    "b01_batch_gate": """
      SELECT 'b' || CAST(o_orderkey AS VARCHAR) AS batch_id,
        CASE WHEN o_orderkey % 7 = 0 THEN 'invalid batch type, only metadata allowed'
             WHEN o_orderkey % 5 = 0 THEN 'invalid batch, no files found'
             WHEN o_orderkey % 11 = 0 THEN 'invalid batch, no metadata files found'
             ELSE 'invalid batch, no data commons found' END AS reason
      FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 9 = 8""",
    "b02_no_rows": B02, "b03_b04_blank_columns": B04, "b05_repeated_headers": B05, "b06_empty_rows": B06,
    "b07_type_given": B07, "b08_type_known_and_single": B08, "b09_key_given": B09, "b10_composite_key": B10,
    "b11_file_ids": B11, "b12_required_columns": B12, "b13_relationship_columns": B13, "b14_b15_repeated_ids": B14,
    "b16_delete_file_names": B16,
    "structure_issues": "SELECT batch_id, file_name, kind, line_number, what FROM bissues",
    "structure_texts": """
      SELECT batch_id, file_name, kind, line_number, CASE kind
        WHEN 'no_rows' THEN '“' || file_name || '": no metadata in the file.'
        WHEN 'extra_cells' THEN '“' || file_name || ': line ' || line_number || '": extra columns/cells found.'
        WHEN 'empty_column' THEN '“' || file_name || '": empty column(s) found.'
        WHEN 'repeated_header' THEN '“' || file_name || '": multiple columns with the same header ("' || what || '") is not allowed.'
        WHEN 'empty_row' THEN '“' || file_name || ': line ' || line_number || '": empty row found.'
        WHEN 'no_type_column' THEN '“' || file_name || '”: “type” column is required.'
        WHEN 'no_type' THEN '“' || file_name || ': line ' || line_number || '": “type” value is required.'
        WHEN 'unknown_type' THEN '“' || file_name || ': ' || line_number || '": Node type “' || what || '” is not defined.'
        WHEN 'no_key_column' THEN '“' || file_name || '”: Key property “' || what || '” is required.'
        WHEN 'no_component_column' THEN '“' || file_name || '”: Column "' || what || '" is required to generate composite ID.'
        WHEN 'no_components' THEN '“' || file_name || ':' || line_number || '”: all properties (' || what ||
          ') needed for composite ID are missing.'
        WHEN 'no_key' THEN '“' || file_name || ':' || line_number || '”:  Key property “' || what || '” value is required.'
        WHEN 'required_column' THEN '“' || file_name || '”: ' || what || ' required.'
        WHEN 'relationships_missing' THEN '“' || file_name || '”: All relationship columns are missing. ' ||
          'Please ensure at least one relationship column is included.'
        WHEN 'unknown_parent' THEN '“' || file_name || '”: Related node "' || what || '" is not defined.'
        WHEN 'undefined_relationship' THEN '“' || file_name || '”: Relationship to "' || what || '" node is not defined.'
        WHEN 'duplicate' THEN '“' || file_name || ':' || line_number || '”: duplicated data detected: “' ||
          'customer_id”: ' || what || '.'
        WHEN 'no_file_name_column' THEN '“' || file_name || '”: Property "' || what || '" is required.'
        WHEN 'no_file_name' THEN '“' || file_name || ':' || line_number || '”:  file name property “' || what || '” value is required.'
      END AS text
      FROM bissues WHERE kind NOT IN ('other_type', 'bad_file_id', 'no_relationships', 'wrong_parent_key', 'conflict')""",
    "b17_capped_report": f"""
      SELECT batch_id, file_name, kind, line_number, what FROM (
        SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY file_name, rank, line_number, kind, what) AS nb FROM (
          SELECT *, row_number() OVER (PARTITION BY batch_id, file_name ORDER BY rank, line_number, kind, what) AS nf
          FROM (SELECT *, {RANK} AS rank FROM bissues)) WHERE nf <= 10) WHERE nb <= 60""",
}



# --- loading -----------------------------------------------------------------------------------
V = file_tables.LOAD_VALUES
cte("lrows", f"""
  SELECT *, {V['batch_id']} AS batch_id, {V['file_name']} AS file_name, CAST({V['line_number']} AS BIGINT) AS line_number,
         {V['part_cell']} AS part_cell, {V['supplier_cell']} AS supplier_cell, {V['scan_cell']} AS scan_cell,
         {V['inner_cell']} AS inner_cell, {V['size_cell']} AS size_cell,
         CASE WHEN l_partkey % 10 = 0 THEN 'dg.4DFC/ab-' ELSE '' END || CAST(l_orderkey AS VARCHAR) || '_' ||
         CAST(l_linenumber AS VARCHAR) AS node_id
  FROM lineitem""")
cte("ledges", """
  SELECT batch_id, file_name, line_number, node_id, 0 AS col, 0 AS nth, 'order' AS parent_type, 'order_id' AS parent_id_prop,
         CAST(l_orderkey AS VARCHAR) AS parent_id_value FROM lrows
  UNION ALL SELECT batch_id, file_name, line_number, node_id, 1, k, 'part', 'part_id', trim(string_split(part_cell, '|')[k])
  FROM (SELECT *, unnest(range(1, len(string_split(part_cell, '|')) + 1)) AS k FROM lrows)
  UNION ALL SELECT batch_id, file_name, line_number, node_id, 2, 0, 'supplier', 'supplier_id', supplier_cell FROM lrows
  WHERE supplier_cell IS NOT NULL""")
cte("lfirst", """SELECT batch_id, file_name, node_id, min(line_number) AS line_number, arg_min(l_orderkey, line_number) AS okey
                 FROM lrows GROUP BY ALL""")
cte("ldistinct", """SELECT DISTINCT batch_id, file_name, node_id, parent_type, parent_id_prop, parent_id_value FROM ledges""")


def uuid5(namespace: str, name: str) -> str:
    """SQL for the version 5 UUID of a name."""
    h = f"sha1(unhex(replace({namespace}, '-', '')) || encode({name}))"
    variant = f"lower(to_hex(('0x' || substr({h}, 17, 2))::INTEGER & 63 | 128))"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} ||"
            f" substr({h}, 19, 2) || '-' || substr({h}, 21, 12))")


cte("one_lines", """SELECT 'S' || CAST(okey % 8 AS VARCHAR) AS submission_id, node_id, arg_max(batch_id, file_name) AS batch_id
                    FROM lfirst GROUP BY ALL""")
cte("old_lines", """SELECT 'S' || CAST(l_orderkey % 8 AS VARCHAR) AS submission_id,
  CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS node_id,
  min('old:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey) AS record_id
  FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL""")
cte("kept_ids", """SELECT record_id, node_type, node_id, study_id, entity_type, submission_id,
  CASE WHEN try_cast(node_id AS BIGINT) % 5 = 0 THEN 'R:' || record_id END AS global_id FROM recs""")
cte("docrows", """SELECT doc_id, 'doc:' || CAST(doc_id AS VARCHAR) AS record_id, 'T' || CAST(doc_id % 2 AS VARCHAR) AS study_id,
  source || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 6 <> 0""")
NEW_LINE = uuid5("'6ba7b812-9dad-11d1-80b4-00c04fd430c8'", "(submission_id || '|lineitem|' || node_id)")
URL = "'6ba7b811-9dad-11d1-80b4-00c04fd430c8'"
SITE_ID = uuid5(URL, f"'{file_tables.SITE}'")
cte("study_ids", f"""SELECT study_id, {uuid5('site', 'study_id')} AS space
                     FROM (SELECT study_id, {SITE_ID} AS site FROM (SELECT DISTINCT study_id FROM docrows))""")

VERSION = """'order:' || CAST(o_orderkey AS VARCHAR) AS record_id"""
ORACLE |= {
    "c01_c02_node_ids": "SELECT file_name, line_number, node_id FROM lrows",
    "c03_parents": """
      SELECT file_name, line_number, CAST(row_number() OVER (PARTITION BY batch_id, file_name, line_number, node_id,
             l ORDER BY col, nth) - 1 AS INTEGER) AS pos, parent_type, parent_id_prop, parent_id_value
      FROM (SELECT *, 0 AS l FROM ledges)""",
    "c04_properties": """
      SELECT file_name, line_number, 'lineitem_id' AS prop, node_id AS value FROM lrows
      UNION ALL SELECT file_name, line_number, 'orderkey', CAST(l_orderkey AS VARCHAR) FROM lrows
      UNION ALL SELECT file_name, line_number, 'linenumber', CAST(l_linenumber AS VARCHAR) FROM lrows
      UNION ALL SELECT file_name, line_number, 'scan', scan_cell FROM lrows
      UNION ALL SELECT file_name, line_number, 'quantity', size_cell FROM lrows
      UNION ALL SELECT file_name, line_number, 'returnflag', l_returnflag FROM lrows""",
    "c05_merged_rows": """
      SELECT f.batch_id, f.file_name, f.node_id, f.line_number,
             (SELECT string_agg(parent_type || '=' || parent_id_value, ',' ORDER BY parent_type || '=' || parent_id_value)
              FROM ldistinct e WHERE e.batch_id = f.batch_id AND e.file_name = f.file_name AND e.node_id = f.node_id) AS parents
      FROM lfirst f""",
    "c05_merged_edges": "SELECT * FROM ldistinct",
    "c06_stored_merge": f"""
      SELECT n.submission_id, n.node_id, o.record_id IS NOT NULL AS was_stored, coalesce(o.record_id, fresh) AS record_id,
             CASE WHEN o.record_id IS NULL THEN batch_id ELSE 'L9,' || batch_id END AS batch_ids,
             CASE WHEN o.record_id IS NULL THEN '2024-05-06' ELSE '2020-01-02' END AS created
      FROM (SELECT *, {NEW_LINE} AS fresh FROM one_lines) n
      LEFT JOIN old_lines o ON o.submission_id = n.submission_id AND o.node_id = n.node_id""",
    "c07_global_ids": """
      SELECT r.record_id,
        CASE WHEN CAST(r.node_id AS BIGINT) % 4 = 0 THEN 'stored' WHEN l.global_id IS NOT NULL THEN 'release'
             WHEN o.global_id IS NOT NULL THEN 'record' WHEN k.global_id IS NOT NULL THEN 'study' ELSE 'new' END AS id_source,
        CASE WHEN CAST(r.node_id AS BIGINT) % 4 = 0 THEN 'mine:' || r.node_id
             ELSE coalesce(l.global_id, o.global_id, k.global_id) END AS global_id
      FROM recs r
      LEFT JOIN (SELECT node_type, node_id, global_id FROM rel_recs WHERE status IS DISTINCT FROM 'Deleted') l
        ON l.node_type = r.node_type AND l.node_id = r.node_id
      LEFT JOIN (SELECT node_type, node_id, min(global_id) AS global_id FROM kept_ids GROUP BY ALL) o
        ON o.node_type = r.node_type AND o.node_id = r.node_id
      LEFT JOIN (SELECT study_id, entity_type, node_id, min(global_id) AS global_id FROM kept_ids
                 WHERE entity_type IS NOT NULL GROUP BY ALL) k
        ON k.study_id = r.study_id AND k.entity_type = r.entity_type AND k.node_id = r.node_id
      WHERE r.node_type = 'customer' AND r.record_id LIKE 'customer:%'""",
    "c08_file_info": """SELECT file_name, line_number, coalesce(inner_cell, scan_cell) AS data_file,
                        CAST(size_cell AS BIGINT) AS size, l_returnflag AS md5 FROM lrows""",
    "c09_stable_file_ids": f"""SELECT record_id, 'dg.4DFC/' || {uuid5('space', 'path')} AS right_id
                               FROM docrows JOIN study_ids USING (study_id)""",
    "k01_upsert": f"""SELECT {VERSION}, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders
                      WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
    "k02_update_fields": f"""SELECT {VERSION}, 'old' AS version, CASE WHEN o_orderkey % 3 <> 0 THEN 'before'
                             WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 2 = 0""",
    "k03_replace_issues": f"""SELECT {VERSION}, 'old' AS version FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0
                              UNION ALL SELECT {VERSION}, 'new' FROM orders WHERE o_orderkey % 15 = 0""",
    "k04_delete_records": f"""SELECT {VERSION}, what FROM orders, (VALUES ('record'), ('issue')) w(what)
                              WHERE o_orderkey % 5 <> 0""",
    "k04_saved_deletion": """
      SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS record_id, 'S' || CAST(o_custkey % 8 AS VARCHAR) AS submission_id
      FROM orders WHERE NOT (o_custkey % 8 = 3 OR (o_custkey % 8 = 5 AND o_orderkey % 2 = 0))""",
    "k04_table_versions": """
      SELECT seen, 'order:' || CAST(o_orderkey AS VARCHAR) AS record_id,
        CASE WHEN seen = 'in the end' AND o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS version
      FROM orders, (SELECT unnest(['while written', 'after a failure', 'in the end']) AS seen)
      WHERE o_orderkey % 2 = 0 OR (seen = 'in the end' AND o_orderkey % 3 = 0)""",
    "k05_insert_absent": """
      SELECT DISTINCT 'S' || CAST(o_custkey % 8 AS VARCHAR) AS submission_id,
             CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders
      EXCEPT SELECT 'S' || CAST(o_custkey % 8 AS VARCHAR), CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END FROM orders
      WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'F'""",
    "k06_ids_except": """SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS node_id FROM orders
                         WHERE o_custkey % 8 = 3 AND o_orderkey % 4 <> 0""",
}


def oracle() -> dict[str, str]:
    return {name: sql(body) for name, body in ORACLE.items()}
