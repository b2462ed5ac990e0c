"""Expected results for data files, deletion, release, export, vocabulary and repairs."""

from __future__ import annotations

from oracle.base import cte, sql, values
from tabgate.messages import CATALOG
from tabgate.operators.backfill import CODES
from tabgate.plans import file_tables

cte("files", file_tables.FILE_SQL)
cte("listing", file_tables.LISTING_SQL)
cte("cached", file_tables.CACHE_SQL)
cte("shared", """
  SELECT submission_id, file_name, md5, count(*) AS n_same,
         max(CASE WHEN md5 IS NULL THEN 1 ELSE 0 END) AS no_md5 FROM files WHERE has_info GROUP BY ALL""")
cte("per_name", "SELECT submission_id, file_name, count(*) AS n FROM shared GROUP BY ALL")
cte("per_sum", "SELECT submission_id, md5, count(*) AS n FROM shared WHERE md5 IS NOT NULL GROUP BY ALL")
cte("fissues", """
  SELECT f.submission_id, f.record_id, f.file_name, f.size, f.md5, l.actual_size, l.actual_md5,
    CASE WHEN NOT has_info THEN 'F009' WHEN f.md5 IS NULL OR f.size = 0 THEN 'F010' WHEN l.file_name IS NULL THEN 'F001'
         WHEN f.size <> actual_size THEN 'F003' WHEN f.md5 <> actual_md5 THEN 'F004' WHEN s.n_same > 1 THEN 'F005'
         WHEN n.n > 1 THEN 'F006' WHEN m.n > 1 THEN 'F007' END AS code
  FROM files f LEFT JOIN listing l ON l.submission_id = f.submission_id AND l.file_name = f.file_name
  LEFT JOIN shared s ON s.submission_id = f.submission_id AND s.file_name = f.file_name AND s.md5 = f.md5
  LEFT JOIN per_name n ON n.submission_id = f.submission_id AND n.file_name = f.file_name
  LEFT JOIN per_sum m ON m.submission_id = f.submission_id AND m.md5 = f.md5""")
cte("forphans", """
  SELECT l.submission_id, l.file_name, coalesce(b.batch_id, '-') AS batch_id, 'F008' AS code FROM listing l
  LEFT JOIN (SELECT doc_id, 'S' || CAST(doc_id % 4 AS VARCHAR) AS submission_id, 'u' || CAST(doc_id AS VARCHAR) || '_1' AS batch_id,
               CASE WHEN doc_id % 2 = 0 THEN 'extra_' ELSE 'orphan_' END || CAST(doc_id AS VARCHAR) AS file_name
             FROM documents WHERE doc_id % 34 = 0 AND doc_id % 85 <> 0) b
    ON b.submission_id = l.submission_id AND b.file_name = l.file_name
  WHERE l.path NOT LIKE '%/log%'
    AND NOT EXISTS (SELECT 1 FROM files f WHERE f.has_info AND f.submission_id = l.submission_id AND f.file_name = l.file_name)""")

# Cascade: one set of expressions per level. Every level drops the edges to the types deleted just before.
cte("drop0", "SELECT record_id, node_type, node_id FROM recs WHERE node_type = 'nation' AND CAST(node_id AS BIGINT) % 5 = 0")
LEVELS = 5
for n in range(1, LEVELS + 1):
    gone = " UNION ALL ".join(f"SELECT record_id FROM drop{k}" for k in range(n))
    lost = " UNION ALL ".join(f"SELECT record_id, parent_type FROM lost{k}" for k in range(1, n)) or \
        "SELECT '' AS record_id, '' AS parent_type"
    cte(f"open{n}", f"""
      SELECT e.record_id, e.parent_type, e.parent_id_value FROM edges e
      WHERE e.record_id NOT IN ({gone}) AND (e.record_id, e.parent_type) NOT IN ({lost})""")
    cte(f"lost{n}", f"""
      SELECT DISTINCT o.record_id, o.parent_type FROM open{n} o
      WHERE o.parent_type IN (SELECT node_type FROM drop{n - 1}) AND o.record_id IN (
        SELECT x.record_id FROM open{n} x JOIN drop{n - 1} p ON p.node_type = x.parent_type AND p.node_id = x.parent_id_value)""")
    cte(f"drop{n}", f"""
      SELECT r.record_id, r.node_type, r.node_id FROM recs r WHERE r.record_id IN (SELECT record_id FROM lost{n})
       AND r.record_id NOT IN (SELECT o.record_id FROM open{n} o LEFT JOIN lost{n} l ON l.record_id = o.record_id
                               AND l.parent_type = o.parent_type WHERE l.record_id IS NULL)""")
cte("dropped", " UNION ALL ".join(f"SELECT record_id, node_type, node_id FROM drop{k}" for k in range(LEVELS + 1)))
cte("lost_all", " UNION ALL ".join(f"SELECT record_id, parent_type FROM lost{k}" for k in range(1, LEVELS + 1)))

KEY = "CAST(node_id AS BIGINT)"
cte("rnew", f"""SELECT *, {KEY} AS k FROM recs WHERE node_type IN ('customer', 'order') AND record_id NOT LIKE 'again:%'""")
cte("rprops", f"""
  SELECT r.record_id, r.node_type, r.node_id, p.prop,
         CASE WHEN r.k % 14 = 0 AND p.prop IN ('segment', 'urgent') THEN ' '
              WHEN r.k % 14 = 0 AND p.prop = 'totalprice' THEN '<Delete>' ELSE p.value END AS value
  FROM rnew r JOIN props p USING (record_id)""")
cte("rchange", """
  SELECT r.record_id, r.node_type, r.node_id, r.k, r.submission_id, s.intention, s.data_type, s.study_id AS sub_study,
         r.study_id, o.release_id, o.submission_id AS old_submission,
         CASE WHEN o.release_id IS NULL THEN 'insert' WHEN s.intention = 'Delete' THEN 'delete' ELSE 'update' END AS change
  FROM rnew r JOIN subs s ON s.submission_id = r.submission_id
  LEFT JOIN rel_recs o ON o.node_type = r.node_type AND o.node_id = r.node_id
  WHERE o.release_id IS NOT NULL OR s.intention <> 'Delete'""")
cte("rel_links", """SELECT DISTINCT node_type AS child_type, node_id AS child_id, parent_type, parent_id_value FROM rel_edges
                    WHERE status IS NULL OR status = 'Released'""")
cte("falling", """
  SELECT node_type, node_id, 0 AS depth FROM rel_recs WHERE node_type = 'nation' AND CAST(node_id AS BIGINT) % 5 = 0
  UNION ALL
  SELECT l.child_type, l.child_id, f.depth + 1 FROM falling f JOIN rel_links l
    ON l.parent_type = f.node_type AND l.parent_id_value = f.node_id WHERE f.depth < 6""")

# What is handed in to be released, the deleting submission first: of equal nodes the last row by file and line.
cte("handed", """
  SELECT * FROM (
    SELECT *, CASE submission_id WHEN 'S7' THEN 2 ELSE 3 END AS turn, row_number() OVER (
      PARTITION BY submission_id = 'S7', node_type, node_id
      ORDER BY file_name || ' ' || printf('%012d', CAST(line_number AS BIGINT)) || ' ' || record_id DESC) AS nth
    FROM recs WHERE coalesce(node_type, '') <> '' AND coalesce(node_id, '') <> '') WHERE nth = 1""")
cte("sinking", """
  SELECT h.node_type, h.node_id, 0 AS depth FROM handed h JOIN rel_recs o ON o.node_type = h.node_type AND o.node_id = h.node_id
  WHERE turn = 2
  UNION ALL
  SELECT l.child_type, l.child_id, s.depth + 1 FROM sinking s JOIN rel_links l
    ON l.parent_type = s.node_type AND l.parent_id_value = s.node_id WHERE s.depth < 6""")
cte("second_release", """
  SELECT o.node_type, o.node_id, o.submission_id, CASE WHEN k.node_id IS NULL THEN o.status ELSE 'Deleted' END AS status,
         CASE WHEN k.node_id IS NOT NULL THEN '2024-05-06' END AS updated
  FROM rel_recs o LEFT JOIN (SELECT DISTINCT node_type, node_id FROM sinking) k
    ON k.node_type = o.node_type AND k.node_id = o.node_id""")

# Exported cells of customers and orders, copies included.
cte("xrecs", f"SELECT *, {KEY} AS k FROM recs WHERE node_type IN ('customer', 'order')")
cte("xkinds", """
  SELECT x.record_id, e.parent_type, arg_min(e.parent_id_prop, e.pos) AS prop,
         string_agg(e.parent_id_value, ' | ' ORDER BY e.pos) AS value
  FROM xrecs x JOIN edges e USING (record_id) GROUP BY ALL""")
cte("xcells", """
  SELECT x.record_id, x.node_type, p.prop AS "column", CASE WHEN x.k % 14 = 0 AND p.prop IN ('segment', 'urgent') THEN ' '
         WHEN x.k % 14 = 0 AND p.prop = 'totalprice' THEN '<Delete>' ELSE p.value END AS value
  FROM xrecs x JOIN props p USING (record_id)
  UNION ALL SELECT record_id, node_type, 'type', node_type FROM xrecs
  UNION ALL SELECT record_id, node_type, 'global_id', 'G:' || node_id FROM xrecs WHERE node_type = 'customer'
  UNION ALL SELECT record_id, node_type, 'flag', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END FROM xrecs
  UNION ALL SELECT record_id, x.node_type, parent_type || '.' || prop, value FROM xkinds JOIN xrecs x USING (record_id)""")
# Exported cells of all types.
cte("yrecs", "SELECT *, CASE WHEN regexp_full_match(node_id, '[0-9]+') THEN CAST(node_id AS BIGINT) END AS k FROM recs WHERE coalesce(node_type, '') <> ''")
cte("ycells", """
  SELECT x.node_type, p.prop AS "column", CASE WHEN x.k % 14 = 0 AND p.prop IN ('segment', 'urgent') THEN ' '
         WHEN x.k % 14 = 0 AND p.prop = 'totalprice' THEN '<Delete>' ELSE p.value END AS value
  FROM yrecs x JOIN props p USING (record_id) WHERE p.prop <> 'type'
  UNION ALL SELECT node_type, 'type', node_type FROM yrecs
  UNION ALL SELECT node_type, 'global_id', 'G:' || node_id FROM yrecs WHERE node_type IN (SELECT node_type FROM mnodes WHERE is_main)
  UNION ALL SELECT node_type, 'flag', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END FROM yrecs
  UNION ALL SELECT x.node_type, e.parent_type || '.' || arg_min(e.parent_id_prop, e.pos),
    string_agg(e.parent_id_value, ' | ' ORDER BY e.pos)
  FROM yrecs x JOIN edges e USING (record_id) GROUP BY x.node_type, x.record_id, e.parent_type""")
CUSTOMER_COLUMNS = ["customer_id", "acctbal", "flag", "galaxy.galaxy_id", "global_id", "name", "nation.nation_id",
                    "nickname", "part.part_id", "segment"]


def wide(columns: list[str]) -> str:
    return ", ".join(f"""max(CASE WHEN "column" = '{c}' THEN value END) AS "{c}" """ for c in columns)


cte("fcounts", """
  SELECT r.submission_id, r.node_type, count(*) AS total,
         count_if(s.intention = 'New/Update' AND o.node_id IS NULL) AS new,
         count_if(s.intention = 'New/Update' AND o.node_id IS NOT NULL) AS "update",
         count_if(s.intention <> 'New/Update') AS "delete"
  FROM recs r JOIN subs s ON s.submission_id = r.submission_id
  LEFT JOIN (SELECT DISTINCT node_type, node_id FROM rel_recs) o ON o.node_type = r.node_type AND o.node_id = r.node_id
  GROUP BY ALL""")
cte("ftotals", """
  SELECT f.submission_id, count(*) AS n_files, CAST(sum(f.size) AS BIGINT) AS total_size FROM files f JOIN subs s USING (submission_id)
  WHERE has_info AND s.data_type <> 'Metadata Only' GROUP BY ALL""")
cte("fsizes", """
  SELECT *, regexp_replace(CAST(CAST(round(total_size / pow(1024, p), 2) AS DECIMAL(18,2)) AS VARCHAR), '0$', '') || ' ' ||
         ['B', 'KB', 'MB', 'GB', 'TB'][CAST(p AS INTEGER) + 1] AS size_text
  FROM (SELECT *, floor(ln(total_size) / ln(1024)) AS p FROM ftotals)""")

# Vocabulary dump.
cte("dumps", """
  SELECT p_partkey AS k, 'E' || CAST(p_partkey % 300 AS VARCHAR) AS code,
    CASE WHEN p_partkey % 4 <> 0 THEN '1.' || CAST(p_partkey % 3 AS VARCHAR) END AS version, p_name AS full_name,
    CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN 'https://x/' || p_brand ELSE p_brand || ' ' END AS v1,
    CASE WHEN p_partkey % 29 <> 0 THEN p_type END AS v2, CASE WHEN p_partkey % 5 <> 0 THEN 'C' || CAST(p_size AS VARCHAR) END AS c1,
    'K' || p_type AS c2, CASE WHEN p_partkey % 6 <> 0 THEN lower(p_brand) END AS s1
  FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0""")
cte("firsts", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, version ORDER BY k) AS nth FROM dumps) WHERE nth = 1""")
cte("elems", """SELECT code, version, full_name, CASE WHEN k % 29 <> 0 AND k % 23 <> 0 THEN trim(v1) || ',' || trim(v2) END AS pvs FROM firsts""")
cte("old_elems", """SELECT code, version, 'old name' AS full_name, 'old' AS pvs FROM elems WHERE code LIKE '%1'
                    UNION ALL SELECT 'Z' || code, version, full_name, pvs FROM elems WHERE code LIKE '%2'""")

cte("okeys", """SELECT *, CAST(o_orderkey AS VARCHAR) AS id, 'S' || CAST(o_custkey % 12 AS VARCHAR) AS submission_id FROM orders""")
cte("catalog_rows", values(
    [{"code": c, "title": t, "severity": v} for c, (t, v, _) in CATALOG.items()], ["code", "title", "severity"], {}))

ORACLE = {
    "a04_file_records": "SELECT submission_id, record_id FROM files WHERE has_info",
    "a07_vocabulary_scan": """
      SELECT CASE WHEN p_partkey % 17 = 0 THEN 'null' WHEN p_partkey % 19 = 0 THEN '' ELSE 'E' || CAST(p_partkey % 300 AS VARCHAR) END AS CDECode,
        CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '1.' || CAST(p_partkey % 3 AS VARCHAR) END AS CDEVersion, p_name AS CDEFullName,
        CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN 'https://x/' || p_brand ELSE p_brand || ' ' END AS value,
        CASE WHEN p_partkey % 5 <> 0 THEN 'C' || CAST(p_size AS VARCHAR) END AS ncit_concept_code,
        CASE WHEN p_partkey % 6 = 0 THEN '' ELSE lower(p_brand) || '~' END AS synonyms FROM part
      UNION ALL
      SELECT CASE WHEN p_partkey % 17 = 0 THEN 'null' WHEN p_partkey % 19 = 0 THEN '' ELSE 'E' || CAST(p_partkey % 300 AS VARCHAR) END,
        CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '1.' || CAST(p_partkey % 3 AS VARCHAR) END, p_name,
        CASE WHEN p_partkey % 29 <> 0 THEN p_type END, 'K' || p_type, p_name FROM part""",
    "a08_rule_rows": """
      SELECT CAST(p_partkey % 3 AS VARCHAR) AS model_version, 'n' || CAST(p_size AS VARCHAR) AS node_type, 'p' || CAST(p_partkey AS VARCHAR) AS prop,
        CASE p_partkey % 8 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' WHEN 2 THEN 'date' WHEN 3 THEN 'value-list'
             WHEN 4 THEN 'number' WHEN 5 THEN 'pattern' ELSE 'string' END AS type,
        p_partkey % 5 IN (0, 1) AS required,
        CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size + 1 AS DOUBLE) WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS min,
        CASE WHEN p_partkey % 7 = 0 THEN TRUE WHEN p_partkey % 2 = 0 THEN FALSE END AS min_exclusive,
        CASE WHEN p_partkey % 11 = 0 THEN CAST(p_size + 99 AS DOUBLE) WHEN p_partkey % 3 = 0 THEN CAST(p_size + 100 AS DOUBLE) END AS max,
        CASE WHEN p_partkey % 11 = 0 THEN TRUE WHEN p_partkey % 3 = 0 THEN FALSE END AS max_exclusive,
        CASE WHEN p_partkey % 8 = 5 THEN '^' || p_brand END AS pattern,
        CASE WHEN p_partkey % 8 = 6 THEN p_type || ',http://kept' WHEN p_partkey % 8 IN (3, 4) THEN p_brand END AS pvs FROM part
      UNION ALL
      SELECT CAST(p_partkey % 3 AS VARCHAR), 'n' || CAST(p_size AS VARCHAR), 'p' || CAST(p_partkey AS VARCHAR) || '_unit', 'string', FALSE,
        NULL, NULL, NULL, NULL, NULL, 'mg,' || p_type FROM part WHERE p_partkey % 8 = 4""",
    "a08_relationship_rules": """
      SELECT node_type, parent_type, arg_max(multiplicity, position) AS multiplicity FROM (
        SELECT 'n' || CAST(l_partkey % 200 AS VARCHAR) AS node_type, 'n' || CAST(l_suppkey % 50 AS VARCHAR) AS parent_type,
          CASE l_linenumber WHEN 1 THEN 'one_to_one' WHEN 3 THEN 'many_to_many' ELSE 'many_to_one' END AS multiplicity,
          l_orderkey * 1000000 + CAST(trunc(l_extendedprice) AS BIGINT) AS position
        FROM lineitem WHERE l_partkey % 200 < 190 AND l_linenumber <> 2
         AND l_partkey % 200 IN (SELECT p_partkey % 180 FROM part)) GROUP BY ALL""",
    "a09_registered_terms": """SELECT 'p' || CAST(p_partkey AS VARCHAR) AS prop, 'D' || CAST(p_partkey AS VARCHAR) AS cde_code,
                               '1.00' AS cde_version FROM part WHERE p_partkey % 13 = 0""",
    "g02_rendered_issues": "SELECT record_id, code, title, severity FROM all_issues JOIN catalog_rows USING (code)",
    "g04_combined_runs": """
      SELECT validation_id, CASE WHEN several AND NOT all_ended THEN NULL WHEN several AND 'Error' IN (ms, fs) THEN 'Error'
               WHEN several AND 'Warning' IN (ms, fs) THEN 'Warning' ELSE status END AS status,
             CASE WHEN several AND NOT all_ended THEN NULL WHEN several THEN strftime(greatest(ended, TIMESTAMP '1997-01-01'), '%Y-%m-%d')
                  ELSE strftime(ended, '%Y-%m-%d') END AS ended, NOT (several AND NOT all_ended) AS updated
      FROM (SELECT CAST(o_orderkey AS VARCHAR) AS validation_id, o_orderdate AS ended,
              CASE o_orderkey % 5 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Failed' ELSE 'Passed' END AS status,
              CASE o_orderkey % 4 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' ELSE 'Passed' END AS ms,
              CASE o_orderkey % 6 WHEN 0 THEN 'Warning' WHEN 1 THEN 'Error' ELSE 'Passed' END AS fs,
              o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 2 AS several, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS all_ended
            FROM orders)""",
    "h01_h04_file_issues": """
      SELECT record_id, code, severity, CASE code WHEN 'F009' THEN 's3FileInfo' WHEN 'F010' THEN 'fileName' WHEN 'F001' THEN 'file'
               WHEN 'F003' THEN 'file size' WHEN 'F004' THEN 'md5' ELSE 'file name' END AS offending_property,
        CASE code WHEN 'F009' THEN '' WHEN 'F010' THEN '' WHEN 'F003' THEN CAST(size AS VARCHAR) WHEN 'F004' THEN md5
             ELSE file_name END AS offending_value,
        CASE code WHEN 'F009' THEN 'Invalid file object, no s3 file info.' WHEN 'F010' THEN 'Invalid s3 data file info.'
             ELSE 'File "' || file_name || '"' || CASE code WHEN 'F001' THEN ' not found.'
               WHEN 'F003' THEN ': expected size: ' || size || ', actual size: ' || actual_size || '.'
               WHEN 'F004' THEN ': expected MD5: ' || md5 || ', actual MD5: ' || actual_md5 || '.'
               WHEN 'F005' THEN ': already exists with the same name and md5 value.'
               WHEN 'F006' THEN ': A file with the same name but different md5 value was found.'
               ELSE ': another file with the same MD5 found.' END END AS description
      FROM fissues JOIN catalog_rows USING (code)""",
    "h03_checksum_reuse": """SELECT l.path, CASE WHEN l.modified_at <= c.modified_at THEN c.md5 ELSE 'to hash' END AS md5
      FROM listing l LEFT JOIN cached c ON c.submission_id = l.submission_id AND c.file_name = l.file_name""",
    "h04_same_content": """
      SELECT s.submission_id, s.file_name, s.md5, s.n_same, n.n AS n_sums, coalesce(m.n, 1) AS n_names FROM shared s
      JOIN per_name n ON n.submission_id = s.submission_id AND n.file_name = s.file_name
      LEFT JOIN per_sum m ON m.submission_id = s.submission_id AND m.md5 = s.md5""",
    "h05_orphans": "SELECT submission_id, file_name, batch_id, code FROM forphans",
    "h06_file_status": """
      SELECT f.submission_id, count(*) AS n_files, coalesce(max(o.n), 0) AS n_orphans,
        CASE WHEN max(o.n) > 0 OR max(i.code) IN ('F001') OR count_if(i.code IN ('F001', 'F003', 'F004', 'F009', 'F010')) > 0 THEN 'Error'
             WHEN count(i.code) > 0 THEN 'Warning' ELSE 'Passed' END AS status
      FROM files f LEFT JOIN fissues i ON i.record_id = f.record_id
      LEFT JOIN (SELECT submission_id, count(*) AS n FROM forphans GROUP BY ALL) o ON o.submission_id = f.submission_id
      GROUP BY f.submission_id""",
    "i01_ids_not_found": "SELECT CAST(n_nationkey * 5 AS VARCHAR) AS node_id FROM nation WHERE n_nationkey >= 5",
    "i02_cascade": """
      SELECT record_id, node_type, node_id, 'deleted' AS action, CAST(NULL AS VARCHAR) AS parents_left FROM dropped
      UNION ALL
      SELECT r.record_id, r.node_type, r.node_id, 'updated',
        (SELECT string_agg(e.parent_type || '=' || e.parent_id_value, ',' ORDER BY e.parent_type || '=' || e.parent_id_value)
         FROM edges e LEFT JOIN lost_all l ON l.record_id = e.record_id AND l.parent_type = e.parent_type
         WHERE e.record_id = r.record_id AND l.record_id IS NULL)
      FROM recs r WHERE r.record_id IN (SELECT record_id FROM lost_all) AND r.record_id NOT IN (SELECT record_id FROM dropped)""",
    "i03_files_to_remove": """SELECT DISTINCT submission_id, file_name FROM files WHERE has_info AND record_id LIKE '%3'""",
    "i04_status_after_delete": """
      SELECT s.submission_id, coalesce(f.n, 0) AS n_records,
        CASE WHEN f.n IS NULL THEN NULL WHEN f.bad > 0 THEN 'Error' ELSE s.given_status END AS metadata_status,
        CASE WHEN s.submission_id = 'S1' THEN 'unchanged'
             WHEN s.submission_id IN (SELECT submission_id FROM listing WHERE submission_id <> 'S2') THEN 'New' END AS file_status
      FROM subs s LEFT JOIN (SELECT submission_id, count(*) AS n, count_if(doc_id % 500 = 1) AS bad FROM files
                             WHERE submission_id <> 'S3' GROUP BY ALL) f ON f.submission_id = s.submission_id""",
    "j01_j03_export_cells": 'SELECT record_id, "column", value FROM xcells',
    "j02_export_customers": f"""SELECT 'customer' AS type, {wide(CUSTOMER_COLUMNS)} FROM xcells WHERE node_type = 'customer'
                                GROUP BY record_id""",
    "j02_written_orders": """SELECT 'order' AS type, node_id AS order_id, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS flag,
      (SELECT value FROM xkinds q WHERE q.record_id = x.record_id) AS customer FROM xrecs x WHERE node_type = 'order'""",
    "j02_all_written": """
      SELECT c.node_type, "column", CASE value WHEN 'True' THEN 'true' WHEN 'False' THEN 'false' ELSE value END AS value, count(*) AS n,
        CAST(CASE WHEN "column" = 'type' THEN 0 WHEN "column" = m.id_prop THEN 1
                  ELSE 2 END AS BIGINT) AS place
      FROM ycells c LEFT JOIN mnodes m USING (node_type) WHERE value <> '' GROUP BY ALL""",
    "j04_export_counts": "SELECT * FROM fcounts",
    "j05_file_totals": "SELECT submission_id, n_files, total_size, size_text FROM fsizes",
    "j06_release_summary": """
      SELECT s.submission_id, t.study_name AS study, s.intention, CAST(count(*) AS VARCHAR) AS n_tables,
        CAST(arg_min(c.total, c.node_type) AS VARCHAR) AS first_total,
        CASE WHEN s.data_type <> 'Metadata Only' THEN coalesce(max(f.size_text), '0B') END AS total_size
      FROM subs s JOIN studies t ON t.study_id = s.study_id JOIN fcounts c ON c.submission_id = s.submission_id
      LEFT JOIN fsizes f ON f.submission_id = s.submission_id GROUP BY s.submission_id, t.study_name, s.intention, s.data_type""",
    "j07_file_manifest": """
      SELECT f.submission_id, 'dg.4DFC/' || CAST(doc_id AS VARCHAR) AS guid, md5, size,
        CASE WHEN NOT controlled_access THEN '[''*'']' WHEN doc_id % 5 = 0 THEN '["*"]'
             WHEN doc_id % 5 = 1 THEN '["' || acc || '.c1", "*"]' ELSE '["' || acc || '"]' END AS acl,
        CASE WHEN NOT controlled_access THEN '[''/open'']' WHEN doc_id % 5 = 0 THEN '["/open"]'
             WHEN doc_id % 5 = 1 THEN '["/programs/' || acc || '.c1", "/open"]' ELSE '["/programs/' || acc || '"]' END AS authz,
        's3://prod/' || study_id || '/' || file_name AS urls
      FROM files f JOIN (SELECT *, string_split(dbgap_id, '.')[1] AS acc FROM subs) s USING (submission_id)
      WHERE has_info AND (NOT controlled_access OR dbgap_id IS NOT NULL)""",
    "j08_release_changes": """SELECT node_type, node_id, change, CASE change WHEN 'delete' THEN 'Deleted' ELSE 'Released' END AS status,
      CASE change WHEN 'delete' THEN old_submission ELSE submission_id END AS submission_id FROM rchange""",
    "j09_release_properties": """
      SELECT c.node_type, c.node_id, p.prop, CASE WHEN lower(trim(p.value)) = '<delete>' THEN NULL
             WHEN c.change = 'update' AND (p.value IS NULL OR trim(p.value) = '') THEN o.value ELSE p.value END AS value
      FROM rchange c JOIN rprops p USING (record_id)
      LEFT JOIN rel_props o ON o.release_id = c.release_id AND o.prop = p.prop
      WHERE c.change <> 'delete' AND NOT (c.change = 'update' AND (p.value IS NULL OR trim(p.value) = '') AND o.prop IS NULL)""",
    "j10_release_parents": """
      SELECT c.node_id, coalesce(CASE WHEN c.change = 'update' AND e.parent_id_value IS NULL THEN NULL ELSE e.parent_id_value END, '') AS parents
      FROM rchange c LEFT JOIN edges e USING (record_id) WHERE c.change <> 'delete' AND c.node_type = 'order'""",
    "j11_release_history": """
      SELECT node_type, node_id, CASE WHEN change = 'insert' THEN 1 ELSE 2 END AS n_entries,
        CASE WHEN change = 'insert' THEN submission_id WHEN k % 2 = 0 THEN 'S?' ELSE old_submission END AS first_submission,
        submission_id AS last_submission, intention AS last_intention
      FROM rchange WHERE change <> 'delete'""",
    "j12_below_deleted": """SELECT DISTINCT node_type, node_id FROM falling WHERE depth > 0""",
    "j13_file_urls": """SELECT node_type, node_id, CASE WHEN data_type <> 'Metadata Only' THEN 's3://dm/' || study_id || '/f' || node_id END
                        AS data_file_location FROM rchange WHERE change = 'insert'""",
    "released_table": """
      SELECT 2 AS version, node_type, node_id, status, submission_id, CAST(0 AS BIGINT) AS n_history, updated FROM second_release
      UNION ALL
      SELECT 3, coalesce(h.node_type, o.node_type), coalesce(h.node_id, o.node_id),
        CASE WHEN h.node_id IS NULL THEN o.status ELSE 'Released' END, coalesce(h.submission_id, o.submission_id),
        CASE WHEN h.node_id IS NULL THEN 0 WHEN o.node_id IS NULL THEN 1 ELSE 2 END,
        CASE WHEN h.node_id IS NULL THEN o.updated WHEN o.node_id IS NOT NULL THEN '2024-05-06' END
      FROM second_release o FULL JOIN (SELECT * FROM handed WHERE turn = 3) h
        ON h.node_type = o.node_type AND h.node_id = o.node_id""",
    "j14_files_to_retire": "SELECT DISTINCT 'S7' AS submission_id, file_name FROM files WHERE has_info AND submission_id = 'S3'",
    "j14_files_to_restore": "SELECT 'file/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents WHERE source IS NOT NULL",
    "l06_appended_synonyms": """
      SELECT synonym, term, NOT bool_or(code LIKE '%1') AS added FROM (
        SELECT code, s1 AS synonym, v1 AS term FROM firsts WHERE s1 IS NOT NULL
        UNION ALL SELECT code, full_name, v2 FROM firsts WHERE s1 IS NOT NULL) GROUP BY synonym, term""",
    "l06_appended_concept_codes": """
      SELECT cde_code, pv, concept_code, NOT bool_or(cde_code LIKE '%1') AS added FROM (
        SELECT code AS cde_code, v1 AS pv, c1 AS concept_code FROM firsts WHERE c1 IS NOT NULL
        UNION ALL SELECT code, v2, c2 FROM firsts WHERE c1 IS NOT NULL) GROUP BY ALL""",
    "l01_l02_elements": "SELECT * FROM elems",
    "l03_synonyms": """SELECT s1 AS synonym, v1 AS term FROM firsts WHERE s1 IS NOT NULL
                       UNION SELECT full_name, v2 FROM firsts WHERE s1 IS NOT NULL""",
    "l04_concept_codes": """SELECT code AS cde_code, v1 AS pv, c1 AS concept_code FROM firsts WHERE c1 IS NOT NULL
                            UNION SELECT code, v2, c2 FROM firsts WHERE c1 IS NOT NULL""",
    "l05_upserted_elements": """
      SELECT coalesce(s.code, f.code) AS code, coalesce(s.version, f.version) AS version,
        CASE WHEN f.code IS NULL THEN s.full_name ELSE f.full_name END AS full_name,
        CASE WHEN f.code IS NULL THEN s.pvs ELSE f.pvs END AS pvs,
        CASE WHEN f.code IS NULL THEN 'kept' WHEN s.code IS NULL THEN 'inserted' ELSE 'updated' END AS change
      FROM old_elems s FULL JOIN elems f ON s.code = f.code AND coalesce(s.version, '') = coalesce(f.version, '')""",
    "n01_study_ids": """SELECT id, CASE WHEN o_custkey % 12 < 8 THEN 'T' || CAST(o_custkey % 12 % 2 AS VARCHAR) ELSE 'T?' END AS study_id
                        FROM okeys""",
    "n02_entity_types": """SELECT id, CASE o_orderkey % 6 WHEN 0 THEN 'Program' WHEN 1 THEN 'Participant' WHEN 2 THEN 'Sample'
                           WHEN 3 THEN 'File' ELSE 'kept' END AS entity_type FROM okeys""",
    "n03_issue_codes": f"""
      SELECT id, CASE WHEN o_orderkey % 8 = 7 THEN 'KEPT' ELSE CASE o_orderkey % 7 WHEN 0 THEN '{CODES['Duplicate IDs']}'
        WHEN 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'M011' WHEN 1 THEN 'M012' END
        WHEN 2 THEN CASE o_orderkey % 3 WHEN 2 THEN 'F011' END WHEN 3 THEN NULL ELSE 'F001' END END AS code FROM okeys""",
    "n04_first_status": "SELECT id, o_orderstatus AS status FROM okeys",
    "n05_id_structs": """SELECT CAST(c_custkey AS VARCHAR) AS id, 0 AS pos, c_mktsegment AS _id FROM customer
                         UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, CAST(c_nationkey AS VARCHAR) FROM customer""",
    "n06_file_locations": """
      SELECT id, CASE WHEN o_orderkey % 13 = 0 THEN 's3://there' WHEN o_orderkey % 6 IN (3, 4) AND o_custkey % 12 < 8 THEN
        's3://bucket' || CAST(o_custkey % 12 % 2 AS VARCHAR) || '/root/' || CAST(o_custkey % 12 AS VARCHAR) || '/file/' ||
        CASE WHEN o_orderkey % 5 > 1 THEN 'a' || o_orderstatus WHEN o_orderkey % 10 <> 0 THEN 'b' END END AS data_file_location
      FROM okeys""",
    "n07_versions": """SELECT id, CASE WHEN o_orderkey % 9 = 0 THEN '3.0' WHEN o_orderkey % 4 = 3 THEN NULL
                       WHEN o_orderkey % 4 IN (0, 1) THEN '2.0' ELSE '1.0' END AS version FROM okeys""",
}

cte("arrived", """SELECT c_custkey // 400 AS b, c_custkey // 100 AS f, c_custkey % 700 = 399 AS bad,
  (c_custkey // 400) % 3 <> 1 OR (c_custkey // 100) % 4 < 3 AS listed FROM customer""")
ORACLE |= {
    "s01_arrived_batches": """
      SELECT 'B' || CAST(b AS VARCHAR) AS batch, status, CASE WHEN b % 7 = 6 THEN 'invalid batch type, only metadata allowed' END AS reason,
        CASE status WHEN 'Uploaded' THEN n_listed ELSE 0 END AS n_records,
        CASE WHEN b % 7 = 6 THEN 0 ELSE n_bad END AS n_issues, CASE WHEN b % 7 = 6 THEN n_files - 1 ELSE n_unlisted END AS n_late
      FROM (
        SELECT b, CASE WHEN b % 7 = 6 THEN 'Failed' WHEN b % 5 = 2 THEN 'Waiting' WHEN count_if(bad AND listed) > 0 THEN 'Failed'
                       ELSE 'Uploaded' END AS status, count_if(listed) AS n_listed, count_if(bad) AS n_bad,
          count(DISTINCT f) AS n_files, count(DISTINCT f) FILTER (NOT listed) AS n_unlisted
        FROM arrived GROUP BY b)""",
    "s02_validate_new": """
      SELECT record_id, code, offending_property, offending_value FROM all_issues
      WHERE record_id IN (SELECT record_id FROM recs WHERE status = 'New')""",
    "s03_running_status": """
      SELECT 'U' || CAST(user_id AS VARCHAR) AS submission_id,
        max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS rank,
        count_if(event_type = 'error') AS n_errors, count_if(event_type = 'click') AS n_warnings
      FROM events GROUP BY user_id""",
}


def oracle() -> dict[str, str]:
    return {name: sql(body) for name, body in ORACLE.items()}
