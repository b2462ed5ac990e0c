"""Expected results of the property, relationship and release checks, and of the roll-ups."""

from __future__ import annotations

from oracle.base import cte, sql

PRE = "'[' || r.file_name || ': line ' || r.line_number || ']'"
ISSUE = "record_id, code, offending_property, offending_value"


def cell_issue(code: str, condition: str, value: str = "original", prop: str = "prop", source: str = "cells") -> str:
    return (
        f"SELECT record_id, '{code}' AS code, {prop} AS offending_property, {value} AS offending_value"
        f" FROM {source} WHERE {condition}"
    )


M003 = cell_issue("M003", "required AND (original IS NULL OR trim(original) = '')")
M033 = cell_issue("M033", "required AND lower(trim(original)) = '<delete>'")
M017 = cell_issue("M017", "NOT has_rule")
D7 = " UNION ALL ".join([
    cell_issue("M030", "what = 'program' AND program_name IS NULL"),
    cell_issue("M028", "what = 'program' AND lower(program_name) <> lower(original)"),
    cell_issue("M029", "what = 'study' AND lower(study_name) <> lower(original)"),
])
D9 = " UNION ALL ".join([
    cell_issue("M031", "type = 'pattern' AND pattern_ok AND NOT regexp_matches(value, '^(?:' || pattern || ')')",
               "value", source="typed"),
    cell_issue("M032", "type = 'pattern' AND NOT pattern_ok", "pattern", source="typed"),
])
M009 = cell_issue("M009", "type = 'blob'", "value", source="typed")
M027 = cell_issue("M027", "cde_missing", "value", source="typed")
M004 = cell_issue("M004", "type = 'integer' AND NOT is_int", "value", source="typed")
M005 = cell_issue("M005", "type = 'number' AND num IS NULL", "value", source="typed")
NUMERIC = "((type = 'integer' AND is_int) OR type = 'number')"
D15 = " UNION ALL ".join([
    cell_issue("M011", f"{NUMERIC} AND min <> 0 AND (num < min OR (min_exclusive AND num = min))", "txt", source="shown"),
    cell_issue("M012", f"{NUMERIC} AND max <> 0 AND (num > max OR (max_exclusive AND num = max))", "txt", source="shown"),
])
M007 = cell_issue("M007", "type IN ('date', 'datetime') AND try_strptime(value, ['%Y-%m-%d', '%m/%d/%Y']) IS NULL",
                  "value", source="typed")
M008 = cell_issue("M008", "type = 'boolean' AND lower(value) NOT IN ('yes', 'true', 'no', 'false')", "value",
                  source="typed")
M010_ONE = cell_issue("M010", "entry IS NULL", "txt", source="terms")
M010_LIST = cell_issue("M010", "entry IS NULL", "item", source="matched_items")
M021 = """SELECT record_id, 'M021' AS code, 'NodeType' AS offending_property, '' AS offending_value FROM recs
          WHERE record_id NOT IN (SELECT record_id FROM props)"""
M035 = """SELECT record_id, 'M035' AS code, 'NodeType' AS offending_property, '' AS offending_value FROM full_recs
          WHERE node_type NOT IN (SELECT node_type FROM mnodes)"""
M022 = """SELECT r.record_id, 'M022' AS code, m.id_prop AS offending_property, '' AS offending_value
          FROM good_recs r JOIN mnodes m USING (node_type) JOIN props p ON p.record_id = r.record_id AND p.prop = m.id_prop
          WHERE trim(p.value) = ''"""

cte("copies", """SELECT submission_id, node_type, node_id, count(*) AS n_copies FROM recs GROUP BY ALL
                 HAVING count(*) > 1""")
cte("dup_issues", """
  SELECT r.record_id, r.submission_id, r.node_type, r.node_id, c.n_copies, m.id_prop AS offending_property,
         p.value AS offending_value, r.file_name, r.line_number
  FROM good_recs r JOIN copies c USING (submission_id, node_type, node_id) JOIN mnodes m USING (node_type)
  LEFT JOIN props p ON p.record_id = r.record_id AND p.prop = m.id_prop
  WHERE p.value IS NULL OR trim(p.value) <> ''""")
M016 = "SELECT record_id, 'M016' AS code, offending_property, offending_value FROM dup_issues"

# --- relations ---------------------------------------------------------------------------------
cte("judged", """
  SELECT r.record_id, r.submission_id, r.node_type, r.node_id, r.file_name, r.line_number, e.pos, e.parent_type,
         e.parent_id_prop, e.parent_id_value, l.multiplicity,
         CASE WHEN e.parent_type NOT IN (SELECT node_type FROM mnodes) THEN 'unknown parent type'
              WHEN NOT EXISTS (SELECT 1 FROM mprops m WHERE m.node_type = e.parent_type AND m.prop = e.parent_id_prop)
                THEN 'not a property of the parent'
              WHEN l.multiplicity IS NULL THEN 'relationship not defined'
              WHEN trim(e.parent_id_value) = '' THEN 'blank parent id' END AS broken
  FROM recs r JOIN edges e USING (record_id)
  LEFT JOIN mrels l ON l.node_type = r.node_type AND l.parent_type = e.parent_type
  WHERE r.node_type IN (SELECT node_type FROM mrels)""")
cte("holders", """SELECT DISTINCT r.submission_id, r.node_type, p.prop, r.node_id FROM recs r JOIN props p USING (record_id)
                  WHERE p.value = r.node_id""")
cte("present_edges", """
  SELECT j.*, h.node_id IS NOT NULL OR x.node_id IS NOT NULL AS present FROM (SELECT * FROM judged WHERE broken IS NULL) j
  LEFT JOIN holders h ON h.submission_id = j.submission_id AND h.node_type = j.parent_type
       AND h.prop = j.parent_id_prop AND h.node_id = j.parent_id_value
  LEFT JOIN (SELECT DISTINCT node_type, node_id FROM rel_recs) x ON x.node_type = j.parent_type
       AND x.node_id = j.parent_id_value""")
cte("multi", """
  SELECT record_id, node_type, node_id, file_name, line_number, parent_type, parent_id_prop, multiplicity,
         '[' || string_agg('"' || parent_id_value || '"', ',' ORDER BY pos) || ']' AS ids
  FROM judged WHERE multiplicity <> 'many_to_many' AND (broken IS NULL OR broken = 'blank parent id')
  GROUP BY ALL HAVING count(*) > 1 AND count_if(broken IS NULL) > 0""")
cte("kids_now", """SELECT DISTINCT r.submission_id, e.parent_type, e.parent_id_prop, e.parent_id_value, r.node_type, r.node_id
                   FROM recs r JOIN edges e USING (record_id)""")
cte("kids_before", "SELECT DISTINCT parent_type, parent_id_prop, parent_id_value, node_type, node_id FROM rel_edges")
cte("kid_groups", """
  SELECT submission_id, parent_type, parent_id_prop, parent_id_value, node_type, count(*) AS n_now
  FROM kids_now GROUP BY ALL""")
cte("kid_members", """
  SELECT submission_id, parent_type, parent_id_prop, parent_id_value, node_type, node_id FROM kids_now
  UNION
  SELECT g2.submission_id, b.* FROM kids_before b JOIN kid_groups g2
    USING (parent_type, parent_id_prop, parent_id_value, node_type) WHERE g2.n_now <= 1""")
cte("kid_all", """
  SELECT submission_id, parent_type, parent_id_prop, parent_id_value, node_type, count(*) AS n_children
  FROM kid_members GROUP BY ALL HAVING count(*) > 1""")
cte("one_to_one", """
  SELECT e.record_id, e.node_type, e.node_id, e.pos, e.parent_type, e.parent_id_value, k.n_children,
         e.file_name, e.line_number
  FROM present_edges e JOIN kid_all k USING (submission_id, parent_type, parent_id_prop, parent_id_value, node_type)
  WHERE e.present AND e.multiplicity = 'one_to_one'""")
E1 = """SELECT record_id, 'M013' AS code, node_type AS offending_property, node_id AS offending_value FROM recs
        WHERE node_type IN (SELECT node_type FROM mrels) AND record_id NOT IN (SELECT record_id FROM edges)"""
E2 = """SELECT record_id, 'M023' AS code, node_type AS offending_property, node_id AS offending_value FROM judged
        WHERE broken IS NOT NULL"""
E3 = """SELECT record_id, CASE WHEN multiplicity = 'one_to_one' THEN 'M024' ELSE 'M025' END AS code,
        node_type AS offending_property, node_id AS offending_value FROM multi"""
E4 = """SELECT record_id, 'M014' AS code, node_type AS offending_property, node_id AS offending_value
        FROM present_edges WHERE NOT present"""
E5 = "SELECT record_id, 'M024' AS code, node_type AS offending_property, node_id AS offending_value FROM one_to_one"

# Consent groups: nations stand in for them, line items for files.
cte("ups", """SELECT DISTINCT r.submission_id, r.node_type, r.node_id, e.parent_type AS up_type, e.parent_id_value AS up_id
              FROM recs r JOIN edges e USING (record_id)""")
cte("rel_ups", "SELECT DISTINCT node_type, node_id, parent_type AS up_type, parent_id_value AS up_id FROM rel_edges")
cte("starts", """SELECT DISTINCT r.submission_id, e.parent_type AS node_type, e.parent_id_value AS node_id
                 FROM recs r JOIN edges e USING (record_id) WHERE r.node_type = 'lineitem'""")
cte("sub_ids", "SELECT DISTINCT submission_id FROM recs")
cte("links", """
  SELECT submission_id, node_type, node_id, up_type, up_id FROM ups
  UNION ALL
  SELECT s.submission_id, b.node_type, b.node_id, b.up_type, b.up_id FROM rel_ups b, sub_ids s
  WHERE NOT EXISTS (SELECT 1 FROM ups u WHERE u.submission_id = s.submission_id AND u.node_type = b.node_type
                    AND u.node_id = b.node_id)""")
cte("stops", "SELECT DISTINCT submission_id, node_type, node_id FROM links WHERE up_type = 'nation'")
cte("climb", """
  SELECT submission_id, node_type AS low_type, node_id AS low_id, node_type, node_id, 0 AS depth FROM starts
  UNION ALL
  SELECT c.submission_id, c.low_type, c.low_id, l.up_type, l.up_id, c.depth + 1 FROM climb c JOIN links l
    USING (submission_id, node_type, node_id)
  WHERE c.depth < 8 AND l.up_type <> 'nation' AND NOT EXISTS (
    SELECT 1 FROM stops s WHERE s.submission_id = c.submission_id AND s.node_type = c.node_type AND s.node_id = c.node_id)""")
cte("reach", """
  SELECT DISTINCT r.submission_id, r.record_id, l.up_id AS group_id
  FROM recs r JOIN edges e USING (record_id)
  JOIN (SELECT DISTINCT submission_id, low_type, low_id, node_type, node_id FROM climb) c
    ON c.submission_id = r.submission_id AND c.low_type = e.parent_type AND c.low_id = e.parent_id_value
  JOIN links l ON l.submission_id = c.submission_id AND l.node_type = c.node_type AND l.node_id = c.node_id
  WHERE r.node_type = 'lineitem' AND l.up_type = 'nation'""")
cte("coded", """
  SELECT submission_id, record_id, coalesce(list_sort(list(code) FILTER (code IS NOT NULL)), []) AS codes,
         coalesce(count_if(code = '-1') > 0 AND count_if(code <> '-1') > 0, FALSE) AS conflict
  FROM (SELECT submission_id, record_id, CASE WHEN group_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)
          THEN CAST(CAST(group_id AS BIGINT) % 6 - 1 AS VARCHAR) END AS code FROM reach)
  GROUP BY submission_id, record_id""")
E7 = """SELECT record_id, 'M036' AS code, 'lineitem' AS offending_property, node_id AS offending_value
        FROM recs JOIN coded USING (record_id) WHERE conflict"""

# --- releases ----------------------------------------------------------------------------------
cte("new_props", """
  SELECT p.record_id, p.prop, coalesce(f.new_value, p.value) AS value FROM props p
  LEFT JOIN fixes f ON f.record_id = p.record_id AND f.prop = p.prop""")
cte("changed_recs", """
  SELECT DISTINCT record_id FROM (
    SELECT r.record_id FROM recs r JOIN alive a USING (node_type, node_id) JOIN new_props p ON p.record_id = r.record_id
      LEFT JOIN rel_props o ON o.release_id = a.release_id AND o.prop = p.prop
     WHERE o.prop IS NULL OR (p.value <> '' AND p.value IS DISTINCT FROM o.value)
    UNION ALL
    SELECT r.record_id FROM recs r JOIN alive a USING (node_type, node_id)
     WHERE (SELECT count(*) FROM edges e WHERE e.record_id = r.record_id)
        <> (SELECT count(*) FROM rel_edges e WHERE e.release_id = a.release_id)
    UNION ALL
    SELECT r.record_id FROM recs r JOIN alive a USING (node_type, node_id) JOIN edges e ON e.record_id = r.record_id
      LEFT JOIN rel_edges o ON o.release_id = a.release_id AND o.parent_type = e.parent_type
       AND o.parent_id_prop = e.parent_id_prop AND o.parent_id_value = e.parent_id_value
     WHERE o.release_id IS NULL)""")
F1 = """SELECT record_id, 'M018' AS code, 'nodeID' AS offending_property, m.id_prop AS offending_value
        FROM changed_recs JOIN recs r USING (record_id) JOIN subs s ON s.submission_id = r.submission_id
        LEFT JOIN mnodes m ON m.node_type = r.node_type WHERE s.intention = 'New/Update'"""
F2 = """SELECT r.record_id, 'M019' AS code, 'nodeID' AS offending_property, m.id_prop AS offending_value
        FROM recs r JOIN subs s ON s.submission_id = r.submission_id AND s.intention = 'Delete'
        LEFT JOIN mnodes m ON m.node_type = r.node_type
        WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.node_type = r.node_type AND a.node_id = r.node_id)"""
cte("pardon", """SELECT r.record_id FROM recs r JOIN subs s ON s.submission_id = r.submission_id
                 JOIN alive a ON a.node_type = r.node_type AND a.node_id = r.node_id
                 WHERE s.intention IN ('New/Update', 'Delete')""")
cte("live_subs", "SELECT submission_id, study_id FROM subs WHERE status IN ('Submitted', 'Released')")
cte("cross_rows", """SELECT r.record_id, r.submission_id, s.study_id, r.node_type, r.node_id FROM recs r
                     JOIN live_subs s ON s.submission_id = r.submission_id""")
cte("cross_members", "SELECT DISTINCT study_id, node_type, node_id, submission_id FROM cross_rows")

# --- everything --------------------------------------------------------------------------------
D5B = """SELECT r.record_id, 'M003' AS code, 'scan' AS offending_property, coalesce(trim(p.value), '') AS offending_value
         FROM recs r LEFT JOIN props p ON p.record_id = r.record_id AND p.prop = 'scan'
         WHERE r.node_type = 'lineitem' AND r.submission_id IN (SELECT submission_id FROM subs WHERE intention = 'Delete')
           AND (p.value IS NULL OR trim(p.value) = '')"""
CHECKED = [M021, M035, M022, M016, M003, M033, M017, D7, D9, M009, M027, M004, M005, D15, M007, M008, M010_ONE,
           M010_LIST, E1, E2, E3, E4, E5, E7]
cte("not_deleting", """SELECT record_id FROM recs WHERE submission_id NOT IN
                       (SELECT submission_id FROM subs WHERE intention = 'Delete')""")
cte("all_issues", f"""
  SELECT * FROM (
    SELECT * FROM ({' UNION ALL '.join(CHECKED)}) WHERE record_id IN (SELECT record_id FROM not_deleting)
    UNION ALL {D5B}) WHERE code NOT IN ('M003', 'M013') OR record_id NOT IN (SELECT record_id FROM pardon)
  UNION ALL SELECT * FROM ({F1}) UNION ALL SELECT * FROM ({F2})""")
cte("ranked", """SELECT record_id, max(CASE WHEN code IN ('M017', 'M018') THEN 1 ELSE 2 END) AS rank,
                 count_if(code NOT IN ('M017', 'M018')) AS n_errors, count_if(code IN ('M017', 'M018')) AS n_warnings
                 FROM all_issues GROUP BY record_id""")
cte("rec_status", """
  SELECT r.submission_id, r.record_id, CASE rank WHEN 2 THEN 'Error' WHEN 1 THEN 'Warning' ELSE 'Passed' END AS status,
         coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings
  FROM recs r LEFT JOIN ranked USING (record_id)""")

D19 = """
      SELECT t.record_id, t.prop || '_concept_code' AS prop, coalesce(string_agg(c.concept_code, '|' ORDER BY nth), '') AS value
      FROM (SELECT record_id, prop, concept_cde, string_split(value, '|') AS parts,
                   unnest(range(1, len(string_split(value, '|')) + 1)) AS nth
            FROM typed WHERE concept_cde IS NOT NULL AND type <> 'pattern') t
      LEFT JOIN concepts c ON c.cde_code = t.concept_cde AND c.pv = trim(t.parts[t.nth])
      GROUP BY t.record_id, t.prop"""
VALIDATED = f"""
  SELECT r.record_id, s.status, CASE WHEN s.status <> 'Passed' THEN 'qc:' || r.record_id END AS issue_id,
    coalesce(p.props, '') AS props, coalesce(g.generated, '') AS generated,
    CASE WHEN c.conflict THEN '' ELSE array_to_string(c.codes, ',') END AS codes
  FROM recs r JOIN rec_status s USING (record_id)
  LEFT JOIN (
    SELECT p.record_id, string_agg(p.prop || '=' || coalesce(f.new_value, p.value, '<null>'), '~'
                                   ORDER BY p.prop || '=' || coalesce(f.new_value, p.value, '<null>')) AS props
    FROM props p LEFT JOIN (SELECT * FROM fixes WHERE record_id IN (SELECT record_id FROM not_deleting)) f
      ON f.record_id = p.record_id AND f.prop = p.prop GROUP BY p.record_id) p ON p.record_id = r.record_id
  LEFT JOIN (
    SELECT record_id, string_agg(prop || '=' || value, '~' ORDER BY prop || '=' || value) AS generated
    FROM ({D19}) WHERE record_id IN (SELECT record_id FROM not_deleting) GROUP BY record_id) g ON g.record_id = r.record_id
  LEFT JOIN (SELECT * FROM coded WHERE record_id IN (SELECT record_id FROM not_deleting)) c ON c.record_id = r.record_id"""

HINT = "' It is recommended to use \"' || advice || '\", as it is semantically equivalent to \"'"


def described(source: str, shown: str) -> str:
    return f"""SELECT record_id, prop AS offending_property, {shown} AS offending_value,
      pre || ' "' || {shown} || '" is not a permissible value for property "' || prop || '".' ||
      coalesce({HINT} || {shown} || '"', '') AS description FROM {source} WHERE entry IS NULL"""


ORACLE = {
    "a02_records_by_scope": """SELECT submission_id, node_type, node_id, record_id FROM recs
                               WHERE submission_id IN ('S1', 'S3') AND status = 'New'""",
    "a03_records_by_type": "SELECT submission_id, node_id, record_id FROM recs WHERE submission_id = 'S2' AND node_type = 'order'",
    "d01_invalid_nodes": f"{M021} UNION ALL {M035}",
    "d02_blank_key": M022,
    "d03_duplicate_ids": """
      SELECT d.record_id, CAST(d.n_copies AS BIGINT) AS n_copies, d.offending_value,
             '[' || d.file_name || ': line ' || d.line_number || '] Same ID also appears in ' ||
             CAST(d.n_copies - 1 AS VARCHAR) || ' other rows of ' || d.node_type || ' ' || d.node_id || '.' AS description
      FROM dup_issues d""",
    "d03_duplicate_members": """SELECT submission_id, node_type, node_id, record_id, CAST(n_copies AS BIGINT) AS n_copies
                                FROM recs JOIN copies USING (submission_id, node_type, node_id)""",
    "d04_undefined_properties": M017,
    "d05_required_blank": M003,
    "d05b_delete_file_name": D5B,
    "d06_required_deleted": M033,
    "d07_registered_names": D7,
    "d08_unknown_types": M009,
    "d09_patterns": D9,
    "d10_effective_vocabulary": """
      SELECT node_type, prop, CAST(coalesce(len(list), 0) AS BIGINT) AS n_entries, cde_missing, concept_cde,
             CASE WHEN len(list) > 0 THEN array_to_string(list_transform(list, lambda x: trim(x)), ',') END AS entries
      FROM eff""",
    "d10_missing_elements": M027,
    "d11_permitted_values": described("terms", "txt"),
    "d11_corrected_values": "SELECT record_id, prop, new_value FROM fixes",
    "d12_recommendations": """SELECT record_id, prop AS offending_property, txt AS offending_value, advice FROM terms
       WHERE entry IS NULL AND advice IS NOT NULL
       UNION ALL SELECT record_id, prop, item, advice FROM matched_items WHERE entry IS NULL AND advice IS NOT NULL""",
    "d13_integers": M004,
    "d14_numbers": M005,
    "d15_bounds": D15,
    "d16_dates": M007,
    "d17_booleans": M008,
    "d18_list_values": described("matched_items", "item"),
    "d19_concept_codes": D19,
    "e01_no_parents": E1,
    "e02_edge_rules": "SELECT record_id, pos, broken FROM judged WHERE broken IS NOT NULL",
    "e03_several_parents": """SELECT record_id, CASE WHEN multiplicity = 'one_to_one' THEN 'M024' ELSE 'M025' END AS code,
      parent_type, '[' || file_name || ': line ' || line_number || '] Associated with multiple "' || parent_type ||
      '" nodes: ' || ids || '.' AS description FROM multi""",
    "e04_absent_parents": """SELECT record_id, pos, parent_type, parent_id_value,
      '[' || file_name || ': line ' || line_number || '] Related node "' || parent_type || '" [“' || parent_id_prop ||
      '”: “' || parent_id_value || '"] not found.' AS description FROM present_edges WHERE NOT present""",
    "e05_one_to_one": """SELECT record_id, pos, parent_type, parent_id_value, CAST(n_children AS BIGINT) AS n_children,
      '"[' || file_name || ': line ' || line_number || ']": associated node “' || parent_type || '”: “' ||
      parent_id_value || '" has multiple nodes associated: ' ||
      CAST(n_children AS VARCHAR) || ' nodes.' AS description
      FROM one_to_one""",
    "e05_children": """
      SELECT submission_id, parent_type, parent_id_prop, parent_id_value, node_type, k.node_id FROM kid_members k
      JOIN kid_all USING (submission_id, parent_type, parent_id_prop, parent_id_value, node_type)
      WHERE node_type IN (SELECT node_type FROM mrels WHERE multiplicity = 'one_to_one' AND mrels.parent_type = k.parent_type)
        AND (parent_type, parent_id_prop, parent_id_value, submission_id) IN
          (SELECT (parent_type, parent_id_prop, parent_id_value, submission_id) FROM present_edges WHERE present)""",
    "e06_consent_groups": "SELECT submission_id, record_id, group_id FROM reach",
    "e07_consent_codes": """SELECT record_id, conflict, CASE WHEN conflict THEN '' ELSE array_to_string(codes, ',') END AS codes
                            FROM coded""",
    "f01_changed_releases": F1,
    "f02_nothing_to_delete": F2,
    "f03_pardoned_issues": f"""SELECT * FROM ({M003} UNION ALL {E1}) WHERE record_id IN (SELECT record_id FROM not_deleting)
                                AND record_id NOT IN (SELECT record_id FROM pardon)""",
    "f04_cross_submission": """
      SELECT r.record_id, CAST(g.n AS BIGINT) AS n_submissions,
             CAST(count(m.submission_id) AS VARCHAR) || ' submissions' AS others
      FROM cross_rows r JOIN (SELECT study_id, node_type, node_id, count(*) AS n FROM cross_members GROUP BY ALL
                              HAVING count(*) > 1) g USING (study_id, node_type, node_id)
      JOIN cross_members m ON m.study_id = r.study_id AND m.node_type = r.node_type AND m.node_id = r.node_id
       AND m.submission_id <> r.submission_id GROUP BY ALL""",
    "f04_cross_members": "SELECT study_id, node_type, node_id, submission_id FROM cross_members",
    "validated_records": VALIDATED,
    "metadata_issues": "SELECT record_id, code, offending_property, offending_value FROM all_issues",
    "g01_record_status": """SELECT record_id, status, CAST(n_errors AS BIGINT) AS n_errors,
                            CAST(n_warnings AS BIGINT) AS n_warnings FROM rec_status""",
    "g03_submission_status": """
      SELECT u.submission_id, CASE WHEN u.given_status IN ('Error', 'New') THEN u.given_status
             WHEN count_if(s.status = 'Error') > 0 THEN 'Error' WHEN count_if(s.status = 'Warning') > 0 THEN 'Warning'
             ELSE u.given_status END AS status, CAST(count_if(s.status = 'Error') AS BIGINT) AS n_errors,
             CAST(count_if(s.status = 'Warning') AS BIGINT) AS n_warnings
      FROM subs u LEFT JOIN rec_status s USING (submission_id) GROUP BY u.submission_id, u.given_status""",
    "g05_qc_rows": """SELECT record_id, CASE rank WHEN 2 THEN 'Error' ELSE 'Warning' END AS severity,
                      CAST(n_errors AS BIGINT) AS n_errors, CAST(n_warnings AS BIGINT) AS n_warnings,
                      'Metadata Validation Service' AS origin FROM ranked""",
    "g06_run_result": """
      SELECT u.submission_id, CAST(count(s.record_id) AS BIGINT) AS n_validated,
             CASE WHEN count(s.record_id) = 0 THEN 'Failed' WHEN count_if(s.status = 'Error') > 0 THEN 'Error'
                  WHEN count_if(s.status = 'Warning') > 0 THEN 'Warning' ELSE 'Passed' END AS result
      FROM subs u LEFT JOIN rec_status s USING (submission_id) GROUP BY u.submission_id""",
}


def oracle() -> dict[str, str]:
    return {name: sql(body) for name, body in ORACLE.items()}
