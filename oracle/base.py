"""Common table expressions over the driver tables, assembled on demand."""

from __future__ import annotations

import re

from tabgate.plans import star

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def _reads(text: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) is not None or f", {name} s" in text


def sql(body: str) -> str:
    """The body with all common table expressions it needs, directly or not."""
    needed: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in entered and _reads(text, name):
                entered.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    heads = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    recursive = "RECURSIVE " if any(_reads(CTES[n], n) for n in needed) else ""
    return f"WITH {recursive}{heads}\n{body}"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(_literal(v) for v in value) + "]"
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[dict], columns: list[str], casts: dict[str, str]) -> str:
    lines = []
    for row in rows:
        cells = [f"CAST({_literal(row[c])} AS {casts.get(c, 'VARCHAR')}) AS {c}" for c in columns]
        lines.append("SELECT " + ", ".join(cells))
    return " UNION ALL ".join(lines)


def _records() -> str:
    parts = []
    for node in star.NODES.values():
        parts.append(
            f"""SELECT {node.record_id} AS record_id, 'S' || CAST({node.submission} AS VARCHAR) AS submission_id,
            'DC' AS data_commons, 'T' || CAST(({node.submission}) % 2 AS VARCHAR) AS study_id, {node.status} AS status,
            {node.file_name} AS file_name, {node.line} AS line_number, {node.node_type} AS node_type,
            {node.node_id} AS node_id, CAST({node.entity_type} AS VARCHAR) AS entity_type
            FROM {node.source} {node.join} WHERE {node.where}"""
        )
    return " UNION ALL ".join(parts)


def _props() -> str:
    parts = []
    for node in star.NODES.values():
        for name, value, present in node.props:
            parts.append(
                f"SELECT {node.record_id} AS record_id, '{name}' AS prop, CAST({value} AS VARCHAR) AS value"
                f" FROM {node.source} {node.join} WHERE ({node.where}) AND ({present})"
            )
    return " UNION ALL ".join(parts)


def _edges() -> str:
    parts = []
    for node in star.NODES.values():
        for at, (kind, prop, value, present) in enumerate(node.parents):
            parts.append(
                f"SELECT {node.record_id} AS record_id, {at} AS ord, '{kind}' AS parent_type,"
                f" '{prop}' AS parent_id_prop, {value} AS parent_id_value"
                f" FROM {node.source} {node.join} WHERE ({node.where}) AND ({present})"
            )
    return " UNION ALL ".join(parts)


cte("recs", _records())
cte("props", _props())
cte("raw_edges", _edges())
cte("edges", """SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY ord) - 1 AS INTEGER) AS pos
                FROM raw_edges""")
cte("subs", star.SUBMISSION_SQL)
cte("studies", star.STUDY_SQL)
cte("orgs", star.ORGANIZATION_SQL)
cte("syns", star.SYNONYM_SQL)
cte("concepts", star.CONCEPT_SQL)
cte("mnodes", values(
    star.model_node_rows(), ["node_type", "ordinal", "id_prop", "is_file", "is_main", "entity_type"],
    {"ordinal": "INTEGER", "is_file": "BOOLEAN", "is_main": "BOOLEAN"}))
cte("mprops", values(
    [dict(r, pattern_ok=bool(r["pattern"]) and r["pattern"] != "(un(closed") for r in star.model_prop_rows()],
    ["node_type", "prop", "type", "required", "min", "min_exclusive", "max", "max_exclusive", "pattern", "pvs",
     "cde_code", "cde_version", "pattern_ok"],
    {"required": "BOOLEAN", "min": "DOUBLE", "max": "DOUBLE", "min_exclusive": "BOOLEAN",
     "max_exclusive": "BOOLEAN", "pvs": "VARCHAR[]", "pattern_ok": "BOOLEAN"}))
cte("mrels", values(star.model_rel_rows(), ["node_type", "parent_type", "multiplicity"], {}))
cte("cdes", """
  SELECT '1001' AS code, '1.00' AS version, ['NOTHING'] AS pvs
  UNION ALL SELECT '1001', '2.00', list_sort(array_agg(DISTINCT c_mktsegment)) FROM customer
  UNION ALL SELECT '1002', '2.00', list_sort(array_agg(DISTINCT o_orderpriority)) FROM orders
  UNION ALL SELECT '1002', '1.00', ['NOTHING']
  UNION ALL SELECT '1003', '1.00', CAST([] AS VARCHAR[])
  UNION ALL SELECT '1005', '1.00', CAST(NULL AS VARCHAR[])""")
cte("chosen", """
  SELECT m.node_type, m.prop, c.code, c.version, c.pvs FROM mprops m JOIN cdes c ON c.code = m.cde_code
   AND c.version = coalesce(m.cde_version, (SELECT max(version) FROM cdes k WHERE k.code = m.cde_code))""")
cte("eff", """
  SELECT m.*, coalesce(c.pvs, m.pvs) AS list, m.cde_code IS NOT NULL AND c.code IS NULL AS cde_missing,
         CASE WHEN len(c.pvs) > 0 THEN c.code END AS concept_cde, c.version AS found_version
  FROM mprops m LEFT JOIN chosen c ON c.node_type = m.node_type AND c.prop = m.prop""")
cte("vocab", """
  SELECT node_type, prop, pos, trim(list[pos]) AS pv
  FROM (SELECT node_type, prop, list_append(list, '<delete>') AS list,
               unnest(range(1, len(list) + 2)) AS pos FROM eff WHERE len(list) > 0)""")
cte("vmatch", """
  SELECT node_type, prop, lower(pv) AS term, arg_min(pv, pos) AS entry, list(pv) AS spellings
  FROM vocab GROUP BY ALL""")
cte("vadvice", """
  SELECT v.node_type, v.prop, lower(s.synonym) AS term, arg_min(v.pv, v.pos) AS advice
  FROM vocab v JOIN syns s ON s.term = v.pv GROUP BY ALL""")
cte("names", """
  SELECT u.submission_id, t.study_name, o.program_name
  FROM subs u LEFT JOIN studies t USING (study_id) LEFT JOIN orgs o ON o.program_id = t.program_id""")
# Usable records: a known type and at least one property.
cte("full_recs", "SELECT * FROM recs WHERE record_id IN (SELECT record_id FROM props)")
cte("good_recs", "SELECT * FROM full_recs WHERE node_type IN (SELECT node_type FROM mnodes)")
cte("cells", """
  SELECT r.record_id, r.submission_id, r.file_name, r.line_number, r.node_type, r.node_id, p.prop,
         p.value AS original, m.entity_type AS entity, e.* EXCLUDE (node_type, prop),
         e.prop IS NOT NULL AS has_rule, n.study_name, n.program_name,
         '[' || r.file_name || ': line ' || r.line_number || ']' AS pre,
         CASE WHEN e.required AND trim(p.value) <> '' AND lower(trim(p.value)) <> '<delete>' AND p.prop = 'name'
              THEN CASE m.entity_type WHEN 'Program' THEN 'program' WHEN 'Study' THEN 'study' END END AS what
  FROM good_recs r JOIN props p USING (record_id) JOIN mnodes m USING (node_type)
  LEFT JOIN eff e ON e.node_type = r.node_type AND e.prop = p.prop LEFT JOIN names n USING (submission_id)""")
cte("vals", """
  SELECT *, CASE WHEN what = 'program' AND lower(program_name) = lower(original) THEN program_name
                 WHEN what = 'study' AND lower(study_name) = lower(original) THEN study_name
                 ELSE original END AS value
  FROM cells""")
cte("typed", """
  SELECT *, regexp_full_match(trim(value), '[+-]?[0-9]+(_[0-9]+)*') AS is_int,
         try_cast(replace(trim(value), '_', '') AS DOUBLE) AS num
  FROM vals WHERE has_rule AND value IS NOT NULL""")
cte("shown", """
  SELECT t.*, CASE WHEN type = 'integer' THEN CAST(try_cast(replace(trim(value), '_', '') AS HUGEINT) AS VARCHAR)
                   ELSE trim(value) END AS txt FROM typed t""")
cte("items", """
  SELECT record_id, node_type, prop, value, file_name, line_number, pre, nth, trim(parts[nth]) AS item, cde_missing
  FROM (SELECT *, string_split(value, '|') AS parts, unnest(range(1, len(string_split(value, '|')) + 1)) AS nth
        FROM typed WHERE type IN ('array', 'value-list') AND len(list) > 0)""")
cte("matched_items", """
  SELECT i.*, m.entry, a.advice,
         CASE WHEN list_contains(m.spellings, i.item) THEN i.item ELSE m.entry END AS fixed
  FROM items i LEFT JOIN vmatch m ON m.node_type = i.node_type AND m.prop = i.prop AND m.term = lower(i.item)
  LEFT JOIN vadvice a ON a.node_type = i.node_type AND a.prop = i.prop AND a.term = lower(i.item)""")
cte("terms", """
  SELECT s.*, m.entry, a.advice, m.spellings FROM shown s
  LEFT JOIN vmatch m ON m.node_type = s.node_type AND m.prop = s.prop AND m.term = lower(s.txt)
  LEFT JOIN vadvice a ON a.node_type = s.node_type AND a.prop = s.prop AND a.term = lower(s.txt)
  WHERE s.type = 'string' AND len(s.list) > 0""")
cte("fixes", """
  SELECT record_id, prop, new_value FROM (
    SELECT s.record_id, s.prop, s.original,
           CASE WHEN s.type = 'boolean' THEN CASE WHEN lower(s.value) IN ('yes', 'true') THEN 'true'
                                                  WHEN lower(s.value) IN ('no', 'false') THEN 'false' ELSE s.value END
                WHEN s.type = 'string' AND coalesce(len(s.list), 0) = 0 THEN trim(s.value)
                WHEN s.type = 'string' THEN coalesce(CASE WHEN list_contains(t.spellings, t.txt) THEN t.txt
                                                          ELSE t.entry END, s.value)
                WHEN s.type IN ('array', 'value-list') AND NOT s.cde_missing THEN coalesce(l.fixed, s.value)
                ELSE s.value END AS new_value
    FROM shown s LEFT JOIN terms t ON t.record_id = s.record_id AND t.prop = s.prop
    LEFT JOIN (SELECT record_id, prop, string_agg(fixed, '|' ORDER BY nth) AS fixed FROM matched_items
               GROUP BY ALL HAVING count(*) = count(fixed)) l ON l.record_id = s.record_id AND l.prop = s.prop)
  WHERE new_value <> original""")
# Earlier releases.
cte("rel_recs", """
  SELECT 'rel:' || record_id AS release_id, 'R' || CAST(CAST(node_id AS BIGINT) % 4 AS VARCHAR) AS submission_id,
         study_id, node_type, node_id, record_id, entity_type, submission_id AS first_submission,
         'G:' || node_type || ':' || node_id AS global_id,
         CASE WHEN node_type IN ('customer', 'order') AND CAST(node_id AS BIGINT) % 11 = 0 THEN 'Deleted'
              WHEN node_type IN ('customer', 'order') AND CAST(node_id AS BIGINT) % 10 = 0 THEN NULL
              ELSE 'Released' END AS status,
         node_type IN ('customer', 'order') AND CAST(node_id AS BIGINT) % 7 = 0 AS changed
  FROM recs WHERE node_type IN ('region', 'nation', 'supplier', 'part', 'customer', 'order')
   AND record_id NOT LIKE 'again:%'
   AND (node_type NOT IN ('customer', 'order') OR CAST(node_id AS BIGINT) % 3 = 0)""")
cte("rel_props", """
  SELECT r.release_id, p.prop, CASE WHEN r.changed AND p.prop = 'name' THEN 'Old name'
         WHEN r.changed AND p.prop = 'totalprice' THEN '1.00' ELSE p.value END AS value
  FROM rel_recs r JOIN props p USING (record_id)""")
cte("rel_edges", "SELECT r.*, e.* EXCLUDE (record_id, ord) FROM rel_recs r JOIN edges e USING (record_id)")
cte("alive", "SELECT * FROM rel_recs WHERE status IS NULL OR status = 'Released'")
