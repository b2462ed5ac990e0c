"""The driver tables seen as submissions.

Every entity table becomes a node type, foreign keys become parent links, and faults are put in
with modulo rules on the keys. The expressions are plain SQL, so that a second engine can derive
the same inputs from the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgate.operators.lookup import SMALL_BYTES, source_bytes
from tabgate.schema import EDGES, MODEL_NODES, MODEL_PROPS, MODEL_RELS, local_table
from tabgate.session import even_reads, stage

DATA_COMMONS, MODEL_VERSION = "DC", "1"


@dataclass(frozen=True)
class Node:
    """How one source table turns into records of one node type."""

    label: str
    source: str
    record_id: str
    submission: str  # number of the submission
    node_type: str
    node_id: str
    id_prop: str
    file_name: str
    line: str
    props: tuple[tuple[str, str, str], ...]  # name, value, presence
    parents: tuple[tuple[str, str, str, str], ...] = ()  # type, id property, value, presence
    entity_type: str = "NULL"
    file_info: str = "NULL"
    status: str = "'New'"
    join: str = ""
    where: str = "TRUE"
    tables: tuple[str, ...] = field(default=())


def dec(column: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,2)) AS STRING)"


def txt(column: str) -> str:
    return f"CAST({column} AS STRING)"


def cycle(expr: str, *cases: tuple[str, str], other: str) -> str:
    whens = " ".join(f"WHEN {expr} % {cond} THEN {value}" for cond, value in cases)
    return f"CASE {whens} ELSE {other} END"


CUSTOMER_PROPS = (
    ("customer_id", cycle("c_custkey", ("113 = 0", "' '"), ("127 = 0", "NULL"), other=txt("c_custkey")), "TRUE"),
    ("name", cycle("c_custkey", ("97 = 0", "''"), ("89 = 0", "'<Delete>'"), ("17 = 0", "'ring makers'"),
                   other="c_name"), "TRUE"),
    ("acctbal", cycle("c_custkey", ("101 = 0", "'n/a'"), ("103 = 0", "'1_0.5'"), other=dec("c_acctbal")), "TRUE"),
    ("segment", cycle("c_custkey", ("166 = 0", "'  syn ' || lower(c_mktsegment) || ' '"), ("83 = 0", "'UNKNOWN'"),
                      ("5 = 0", "lower(c_mktsegment)"), ("107 = 0", "'<DELETE>'"), other="c_mktsegment"), "TRUE"),
    ("nickname", "c_name", "c_custkey % 41 = 0"),
)
CUSTOMER_PRESENT = "c_custkey % 223 <> 0"


def _customer(label: str, record_id: str, submission: str, where: str) -> Node:
    return Node(
        label=label,
        source="customer",
        record_id=record_id,
        submission=submission,
        node_type=cycle("c_custkey", ("211 = 0", "'custmer'"), other="'customer'"),
        node_id=txt("c_custkey"),
        id_prop="customer_id",
        file_name="'customer_' || CAST(c_custkey % 4 AS STRING) || '.tsv'",
        line="CAST(c_custkey AS INT) + 2",
        props=tuple((n, v, f"({p}) AND {CUSTOMER_PRESENT}") for n, v, p in CUSTOMER_PROPS),
        parents=(
            ("nation", "nation_id", cycle("c_custkey", ("71 = 0", "CAST(c_nationkey + 10000000 AS STRING)"),
                                          ("109 = 0", "' '"), other=txt("c_nationkey")), "c_custkey % 131 <> 0"),
            ("nation", "nation_id", "CAST((c_nationkey + 1) % 25 AS STRING)",
             "c_custkey % 67 = 0 AND c_custkey % 131 <> 0"),
            ("galaxy", "galaxy_id", "'milky'", "c_custkey % 139 = 0"),
            ("nation", "anthem", "'la la'", "c_custkey % 149 = 0"),
            ("part", "part_id", "'1'", "c_custkey % 151 = 0"),
        ),
        entity_type="'Program'",
        status=cycle("c_custkey", ("2 = 0", "'New'"), other="'Passed'"),
        where=where,
        tables=("customer",),
    )


NODES: dict[str, Node] = {
    "region": Node(
        label="region", source="region", record_id="'region:' || CAST(r_regionkey AS STRING)", submission="0",
        node_type="'region'", node_id=txt("r_regionkey"), id_prop="region_id", file_name="'region.tsv'",
        line="CAST(r_regionkey AS INT) + 2",
        props=(("region_id", txt("r_regionkey"), "TRUE"), ("name", "r_name", "TRUE")), tables=("region",),
    ),
    "nation": Node(
        label="nation", source="nation", record_id="'nation:' || CAST(n_nationkey AS STRING)", submission="0",
        node_type="'nation'", node_id=txt("n_nationkey"), id_prop="nation_id", file_name="'nation.tsv'",
        line="CAST(n_nationkey AS INT) + 2",
        props=(("nation_id", txt("n_nationkey"), "TRUE"), ("name", "n_name", "TRUE"),
               ("consent_group_number", "CAST(n_nationkey % 6 - 1 AS STRING)", "TRUE")),
        parents=(("region", "region_id", txt("n_regionkey"), "TRUE"),), tables=("nation",),
    ),
    "supplier": Node(
        label="supplier", source="supplier", record_id="'supplier:' || CAST(s_suppkey AS STRING)", submission="0",
        node_type="'supplier'", node_id=txt("s_suppkey"), id_prop="supplier_id", file_name="'supplier.tsv'",
        line="CAST(s_suppkey AS INT) + 2",
        props=(("supplier_id", txt("s_suppkey"), "TRUE"), ("name", "s_name", "TRUE"),
               ("acctbal", dec("s_acctbal"), "TRUE")),
        parents=(("nation", "nation_id", txt("s_nationkey"), "TRUE"),), tables=("supplier",),
    ),
    "part": Node(
        label="part", source="part", record_id="'part:' || CAST(p_partkey AS STRING)", submission="0",
        node_type="'part'", node_id=txt("p_partkey"), id_prop="part_id", file_name="'part.tsv'",
        line="CAST(p_partkey AS INT) + 2",
        props=(
            ("part_id", txt("p_partkey"), "TRUE"),
            ("name", "p_name", "TRUE"),
            ("brand", cycle("p_partkey", ("83 = 0", "'NoBrand'"), ("5 = 0", "lower(p_brand)"), other="p_brand"), "TRUE"),
            ("type", cycle("p_partkey", ("61 = 0", "p_type || '|odd|' || lower(p_type)"),
                           ("3 = 0", "p_type || ' | ' || lower(p_type)"), other="p_type"), "TRUE"),
            ("size", cycle("p_partkey", ("79 = 0", "'12x'"), ("53 = 0", "'1_2'"), ("59 = 0", "'-3'"),
                           other=txt("p_size")), "TRUE"),
            ("retailprice", dec("p_retailprice"), "TRUE"),
            ("code", cycle("p_partkey", ("37 = 0", "'x' || p_brand"), other="p_brand || '/a'"), "TRUE"),
            ("shape", "'round'", "p_partkey % 53 = 0"),
            ("finish", "'matt'", "p_partkey % 47 = 0"),
            ("weight", "'heavy'", "p_partkey % 59 = 0"),
        ),
        entity_type="'Study'", tables=("part",),
    ),
    "customer": _customer("customer", "'customer:' || CAST(c_custkey AS STRING)", "c_custkey % 8", "TRUE"),
    # The same customers handed in once more, under another submission of the same study.
    "customer_again": _customer("customer_again", "'again:' || CAST(c_custkey AS STRING)", "(c_custkey + 2) % 8",
                                "c_custkey % 13 = 0"),
    "order": Node(
        label="order", source="orders", record_id="'order:' || CAST(o_orderkey AS STRING)",
        submission="o_custkey % 8", node_type="'order'", node_id=txt("o_orderkey"), id_prop="order_id",
        file_name="'order_' || CAST(o_orderkey % 8 AS STRING) || '.tsv'", line="CAST(o_orderkey AS INT) + 2",
        props=(
            ("order_id", txt("o_orderkey"), "TRUE"),
            ("status", cycle("o_orderkey", ("83 = 0", "'Z'"), ("97 = 0", "NULL"), ("5 = 0", "lower(o_orderstatus)"),
                             other="o_orderstatus"), "TRUE"),
            ("totalprice", cycle("o_orderkey", ("101 = 0", "'1e400x'"), other=dec("o_totalprice")), "TRUE"),
            ("orderdate", cycle("o_orderkey", ("73 = 0", "'1998/13/45'"),
                                ("3 = 0", "substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' || "
                                          "substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' || "
                                          "substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)"),
                                other="CAST(CAST(o_orderdate AS DATE) AS STRING)"), "TRUE"),
            ("priority", cycle("o_orderkey", ("83 = 1", "'syn ' || o_orderpriority"),
                               ("7 = 0", "lower(o_orderpriority)"), other="o_orderpriority"), "TRUE"),
            ("urgent", cycle("o_orderkey", ("61 = 0", "'maybe'"), ("3 = 0", "'Yes'"), ("3 = 1", "'no'"),
                             other="'TRUE'"), "TRUE"),
            ("tags", cycle("o_orderkey", ("59 = 0", "o_orderpriority || '|syn ' || lower(o_orderpriority)"),
                           ("4 = 0", "lower(o_orderpriority) || ' | 5-LOW'"), other="o_orderpriority"), "TRUE"),
            ("note", "'see ' || o_orderpriority", "o_orderkey % 43 = 0"),
        ),
        parents=(("customer", "customer_id", cycle("o_orderkey", ("71 = 0", "CAST(o_custkey + 10000000 AS STRING)"),
                                                   other=txt("o_custkey")), "o_orderkey % 137 <> 0"),),
        status=cycle("o_orderkey", ("2 = 0", "'New'"), other="'Passed'"),
        tables=("orders",),
    ),
    "lineitem": Node(
        label="lineitem", source="lineitem",
        record_id="'line:' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || "
                  "CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) || '_' || "
                  "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) || '_' || "
                  "CAST(CAST(l_discount * 100 AS INT) * 100 + CAST(l_tax * 100 AS INT) AS STRING) || '_' || "
                  "CAST(CAST(l_shipdate AS DATE) AS STRING)",
        submission="o_custkey % 8", node_type="'lineitem'",
        node_id="CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING)", id_prop="lineitem_id",
        file_name="'lineitem_' || CAST(l_partkey % 16 AS STRING) || '.tsv'", line="CAST(l_suppkey AS INT) + 2",
        props=(
            ("lineitem_id", "CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING)", "TRUE"),
            ("quantity", cycle("l_partkey", ("79 = 0", "'12x'"), other="CAST(CAST(l_quantity AS INT) AS STRING)"), "TRUE"),
            ("discount", dec("l_discount"), "TRUE"),
            ("returnflag", cycle("l_partkey", ("5 = 0", "lower(l_returnflag)"), other="l_returnflag"), "TRUE"),
            ("shipdate", cycle("l_partkey", ("73 = 0", "'soon'"), other="CAST(CAST(l_shipdate AS DATE) AS STRING)"), "TRUE"),
            ("scan", cycle("l_partkey", ("97 = 0", "''"), other="'scan_' || CAST(l_partkey AS STRING) || '.pdf'"),
             "l_partkey % 89 <> 0"),
        ),
        parents=(
            ("order", "order_id", txt("l_orderkey"), "TRUE"),
            ("part", "part_id", txt("l_partkey"), "TRUE"),
            ("supplier", "supplier_id", cycle("l_partkey", ("71 = 0", "CAST(l_suppkey + 10000000 AS STRING)"),
                                              other=txt("l_suppkey")), "TRUE"),
        ),
        entity_type="'File'",
        join="JOIN orders ON o_orderkey = l_orderkey", tables=("lineitem", "orders"),
    ),
}

ALL = tuple(NODES)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def spread_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """The tables, small ones dealt over more pieces: what is made of their rows is far larger than they are. Large ones are
    read in pieces anyway."""
    for name in names:
        rows = table(spark, sf_dir, name)
        if source_bytes(rows) <= SMALL_BYTES:
            rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, rows.columns[0])
        rows.createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = ALL) -> DataFrame:
    """Records of the chosen node types, unvalidated."""
    parts = []
    for label in labels:
        node = NODES[label]
        spread_tables(spark, sf_dir, *node.tables)
        parts.append(spark.sql(_record_sql(node)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _record_sql(node: Node) -> str:
    entries = ", ".join(
        f"CASE WHEN {present} THEN named_struct('key', '{name}', 'value', CAST({value} AS STRING)) END"
        for name, value, present in node.props
    )
    edges = ", ".join(
        f"CASE WHEN {present} THEN named_struct('parent_type', '{kind}', 'parent_id_prop', '{prop}',"
        f" 'parent_id_value', {value}) END"
        for kind, prop, value, present in node.parents
    )
    parents = f"filter(array({edges}), e -> e IS NOT NULL)" if edges else f"CAST(array() AS {EDGES})"
    return f"""
      SELECT {node.record_id} AS record_id, 'S' || CAST({node.submission} AS STRING) AS submission_id,
             '{DATA_COMMONS}' AS data_commons, '{MODEL_VERSION}' AS model_version,
             'T' || CAST(({node.submission}) % 2 AS STRING) AS study_id, {node.status} AS status,
             {node.file_name} AS file_name, {node.line} AS line_number, {node.node_type} AS node_type,
             {node.node_id} AS node_id, '{node.id_prop}' AS id_prop,
             map_from_entries(filter(array({entries}), e -> e IS NOT NULL)) AS props,
             {parents} AS parents, {node.entity_type} AS entity_type
      FROM {node.source} {node.join} WHERE {node.where}
    """


# --- submissions, studies, organizations -------------------------------------------------------

SUBMISSION_SQL = """
  SELECT 'S' || CAST(n AS STRING) AS submission_id, 'DC' AS data_commons, '1' AS model_version,
         'T' || CAST(n % 2 AS STRING) AS study_id,
         CASE WHEN n < 4 THEN 'Submitted' WHEN n < 6 THEN 'Released' ELSE 'New' END AS status,
         CASE WHEN n = 7 THEN 'Delete' WHEN n = 6 THEN 'New' ELSE 'New/Update' END AS intention,
         CASE WHEN n = 5 THEN 'Metadata Only' ELSE 'Metadata and Data Files' END AS data_type,
         n % 3 <> 0 AS controlled_access,
         CASE WHEN n = 4 THEN NULL ELSE 'phs' || CAST(1000 + n AS STRING) || '.v1' END AS dbgap_id,
         'bucket' || CAST(n % 2 AS STRING) AS bucket_name, 'root/' || CAST(n AS STRING) AS root_path,
         CASE WHEN n % 2 = 0 THEN 'Warning' ELSE 'Passed' END AS given_status,
         CASE WHEN n % 3 = 0 THEN '0000-000' || CAST(n AS STRING) END AS orcid
  FROM (SELECT DISTINCT c_custkey % 8 AS n FROM customer) AS numbers
"""

STUDY_SQL = """
  SELECT 'T' || CAST(k AS STRING) AS study_id,
         CASE WHEN k = 0 THEN 'Red WIDGET' ELSE 'blue' END AS study_name,
         CASE WHEN k = 0 THEN 'P0' ELSE 'P9' END AS program_id
  FROM (SELECT DISTINCT c_custkey % 2 AS k FROM customer) AS numbers
"""

ORGANIZATION_SQL = """
  SELECT 'P' || CAST(k AS STRING) AS program_id, 'Ring Makers' AS program_name
  FROM (SELECT DISTINCT c_custkey % 1 AS k FROM customer) AS numbers
"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer")
    return spark.sql(SUBMISSION_SQL)


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer")
    return spark.sql(STUDY_SQL)


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer")
    return spark.sql(ORGANIZATION_SQL)


# --- the data model ----------------------------------------------------------------------------

_NODE_ROWS = [
    # node type, id property, composite key, is file, entity type
    ("region", "region_id", None, False, None),
    ("nation", "nation_id", None, False, None),
    ("customer", "customer_id", None, False, "Program"),
    ("supplier", "supplier_id", None, False, None),
    ("part", "part_id", None, False, "Study"),
    ("order", "order_id", None, False, None),
    ("lineitem", "lineitem_id", ["orderkey", "linenumber"], True, "File"),
]

_PROP_ROWS = [
    # node type, property, type, required, own list, (min, exclusive), (max, exclusive), pattern, cde, version
    ("region", "region_id", "string", True, None, None, None, None, None, None),
    ("region", "name", "string", True, ["AFRICA", "AMERICA", "ASIA", "EUROPE"], None, None, None, None, None),
    ("nation", "nation_id", "string", True, None, None, None, None, None, None),
    ("nation", "name", "string", True, None, None, None, None, None, None),
    ("nation", "consent_group_number", "integer", False, None, None, None, None, None, None),
    ("supplier", "supplier_id", "string", True, None, None, None, None, None, None),
    ("supplier", "name", "string", True, None, None, None, None, None, None),
    ("supplier", "acctbal", "number", False, None, (0.0, True), None, None, None, None),
    ("customer", "customer_id", "string", True, None, None, None, None, None, None),
    ("customer", "name", "string", True, None, None, None, None, None, None),
    ("customer", "acctbal", "number", False, None, (-900.0, False), (9500.0, True), None, None, None),
    ("customer", "segment", "string", True, ["HOUSEHOLD"], None, None, None, "1001", None),
    ("part", "part_id", "string", True, None, None, None, None, None, None),
    ("part", "name", "string", True, None, None, None, None, None, None),
    ("part", "brand", "string", False, ["Brand#1 ", "Brand#2", "Brand#3"], None, None, None, "1004", "1.00"),
    ("part", "type", "array", False, ["STANDARD", "ECONOMY", "PROMO", "MEDIUM", "LARGE", "SMALL"], None, None,
     None, None, None),
    ("part", "size", "integer", False, None, (0.0, False), (45.0, True), None, None, None),
    ("part", "retailprice", "number", False, None, (905.0, True), None, None, "1003", "1.00"),
    ("part", "code", "pattern", False, None, None, None, "[A-Z][a-z]+#\\d", None, None),
    ("part", "shape", "pattern", False, None, None, None, None, None, None),
    ("part", "finish", "pattern", False, None, None, None, "(un(closed", None, None),
    ("part", "weight", "blob", False, None, None, None, None, None, None),
    ("order", "order_id", "string", True, None, None, None, None, None, None),
    ("order", "status", "string", True, ["F", "O", "P"], None, None, None, None, None),
    ("order", "totalprice", "number", False, None, (1500.0, True), (450000.0, False), None, None, None),
    ("order", "orderdate", "date", False, None, None, None, None, None, None),
    ("order", "priority", "string", False, None, None, None, None, "1002", "2.00"),
    ("order", "urgent", "boolean", False, None, None, None, None, None, None),
    ("order", "tags", "value-list", False, None, None, None, None, "1002", "2.00"),
    ("lineitem", "lineitem_id", "string", True, None, None, None, None, None, None),
    ("lineitem", "quantity", "integer", False, None, (2.0, False), (49.0, False), None, None, None),
    ("lineitem", "discount", "number", False, None, None, (0.1, True), None, None, None),
    ("lineitem", "returnflag", "string", False, ["A", "N", "R"], None, None, None, "1005", "1.00"),
    ("lineitem", "shipdate", "datetime", False, None, None, None, None, None, None),
    ("lineitem", "scan", "string", False, None, None, None, None, None, None),
]

_REL_ROWS = [
    ("nation", "region", "many_to_one"),
    ("customer", "nation", "many_to_one"),
    ("supplier", "nation", "one_to_one"),
    ("order", "customer", "one_to_one"),
    ("lineitem", "order", "many_to_one"),
    ("lineitem", "part", "many_to_many"),
    ("lineitem", "supplier", "many_to_many"),
]


def model_node_rows() -> list[dict]:
    return [
        {
            "data_commons": DATA_COMMONS, "model_version": MODEL_VERSION, "node_type": kind, "ordinal": at,
            "id_prop": id_prop, "comp_key": comp, "is_file": is_file,
            "name_field": "scan" if is_file else None, "size_field": "quantity" if is_file else None,
            "md5_field": "returnflag" if is_file else None,
            "is_main": entity is not None, "entity_type": entity,
        }
        for at, (kind, id_prop, comp, is_file, entity) in enumerate(_NODE_ROWS)
    ]


def model_prop_rows() -> list[dict]:
    rows = []
    for kind, prop, type_, required, own, low, high, pattern, cde, version in _PROP_ROWS:
        rows.append(
            {
                "data_commons": DATA_COMMONS, "model_version": MODEL_VERSION, "node_type": kind, "prop": prop,
                "type": type_, "required": required, "min": low and low[0], "min_exclusive": low and low[1],
                "max": high and high[0], "max_exclusive": high and high[1], "pattern": pattern, "pvs": own,
                "cde_code": cde, "cde_version": version,
            }
        )
    return rows


def model_rel_rows() -> list[dict]:
    return [
        {"data_commons": DATA_COMMONS, "model_version": MODEL_VERSION, "node_type": child, "parent_type": parent,
         "multiplicity": multiplicity}
        for child, parent, multiplicity in _REL_ROWS
    ]


def model_nodes(spark: SparkSession) -> DataFrame:
    return local_table(spark, model_node_rows(), MODEL_NODES)


def model_props(spark: SparkSession) -> DataFrame:
    return local_table(spark, model_prop_rows(), MODEL_PROPS)


def model_rels(spark: SparkSession) -> DataFrame:
    return local_table(spark, model_rel_rows(), MODEL_RELS)


# --- vocabulary --------------------------------------------------------------------------------

CDE_SQL = """
  SELECT '1001' AS code, '1.00' AS version, 'segment' AS full_name, array('NOTHING') AS pvs
  UNION ALL SELECT '1001', '2.00', 'segment', array_sort(collect_set(c_mktsegment)) FROM customer
  UNION ALL SELECT '1002', '2.00', 'priority', array_sort(collect_set(o_orderpriority)) FROM orders
  UNION ALL SELECT '1002', '1.00', 'priority', array('NOTHING')
  UNION ALL SELECT '1003', '1.00', 'price', CAST(array() AS ARRAY<STRING>)
  UNION ALL SELECT '1005', '1.00', 'flag', CAST(NULL AS ARRAY<STRING>)
"""

SYNONYM_SQL = """
  SELECT DISTINCT 'SYN ' || c_mktsegment AS synonym, c_mktsegment AS term FROM customer
  UNION ALL SELECT DISTINCT 'Syn ' || o_orderpriority, o_orderpriority FROM orders
"""

CONCEPT_SQL = """
  SELECT DISTINCT '1001' AS cde_code, c_mktsegment AS pv,
         'C' || CAST(length(c_mktsegment) AS STRING) || substr(c_mktsegment, 1, 2) AS concept_code FROM customer
  UNION ALL SELECT DISTINCT '1002', o_orderpriority, 'C' || substr(o_orderpriority, 1, 3) FROM orders
"""


def cde(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer", "orders")
    return spark.sql(CDE_SQL)


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer", "orders")
    return spark.sql(SYNONYM_SQL)


def concept_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer", "orders")
    return spark.sql(CONCEPT_SQL)


# --- releases ----------------------------------------------------------------------------------

# Which records have been released before, and how the released row differs.
RELEASED_WHERE = "(node_type NOT IN ('customer', 'order') OR key_number % 3 = 0)"


def releases(spark: SparkSession, sf_dir: str, labels=("region", "nation", "supplier", "part", "customer", "order")):
    """Earlier releases: reference data whole, customers and orders for one key in three."""
    rows = records(spark, sf_dir, tuple(labels)).filter(F.col("node_type") != "custmer")
    key = F.col("node_id").try_cast("bigint")
    moving = F.col("node_type").isin("customer", "order")
    rows = rows.filter(~moving | (key % 3 == 0))
    changed = moving & (key % 7 == 0)
    props = F.when(
        changed, F.transform_values("props", lambda k, v: F.when(k == "name", F.lit("Old name"))
                                    .when(k == "totalprice", F.lit("1.00")).otherwise(v))
    ).otherwise(F.col("props"))
    return rows.select(
        F.concat(F.lit("rel:"), "record_id").alias("release_id"),
        F.concat(F.lit("R"), (key % 4).cast("string")).alias("submission_id"),
        "data_commons", "study_id",
        F.when(moving & (key % 11 == 0), "Deleted").when(moving & (key % 10 == 0), F.lit(None))
        .otherwise("Released").alias("status"),
        "node_type", "node_id",
        F.concat(F.lit("G:"), "node_type", F.lit(":"), "node_id").alias("global_id"),
        props.alias("props"), "parents", "entity_type",
    )


# --- stored tables -----------------------------------------------------------------------------

_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``records`` or ``releases`` as a stored table: written once per session and folder, then scanned
    like the stored records of a running service."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        rows = records(spark, sf_dir) if name == "records" else releases(spark, sf_dir)
        _STORED[key] = stage(rows, name)
        even_reads(spark)
    return _STORED[key]


def stored_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions, stored once per session and folder. They are worked out of all customers, and the planner would take
    their size for that of the customers and shuffle all records by a handful of submissions."""
    key = (spark.sparkContext.applicationId, sf_dir, "submissions")
    if key not in _STORED:
        _STORED[key] = stage(submissions(spark, sf_dir), "submissions")
    return _STORED[key]
