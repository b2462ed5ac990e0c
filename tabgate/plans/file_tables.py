"""Loading rows, data files and vocabulary dumps made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgate.plans import star

SITE = "https://hub.example.org/"

# Sheet rows of line items, with the facts of their file. Shared by both engines but for the arrays.
LOAD_VALUES = {
    "batch_id": "'L' || CAST(l_orderkey % 3 AS STRING)",
    "file_name": "'lines_' || CAST(l_orderkey % 3 AS STRING) || CAST(l_orderkey % 20 AS STRING) || '.tsv'",
    "line_number": "CAST(round(l_extendedprice * 100) AS INT)",
    "given_id": "CASE WHEN l_partkey % 10 = 0 THEN 'DG.4dfc/AB-' || CAST(l_orderkey AS STRING) || '_' || "
                "CAST(l_linenumber AS STRING) END",
    "part_cell": "CASE WHEN l_partkey % 7 = 0 THEN CAST(l_partkey AS STRING) || ' | ' || CAST(l_partkey + 1 AS STRING)"
                 " ELSE CAST(l_partkey AS STRING) END",
    "supplier_cell": "CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_suppkey AS STRING) END",
    "scan_cell": "CASE WHEN l_partkey % 9 <> 0 THEN 'scan_' || CAST(l_partkey AS STRING) END",
    "inner_cell": "CASE WHEN l_partkey % 4 = 0 THEN 'sub/' || CAST(l_partkey AS STRING) END",
    "size_cell": "CAST(CAST(l_quantity AS INT) AS STRING)",
}


def load_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    star.spread_tables(spark, sf_dir, "lineitem")
    v = LOAD_VALUES
    return spark.sql(f"""
      SELECT {v['batch_id']} AS batch_id, {v['file_name']} AS file_name, {v['line_number']} AS line_number,
        'lineitem' AS node_type, 'lineitem_id' AS id_prop, array('orderkey', 'linenumber') AS comp_key, TRUE AS is_file,
        'scan' AS name_field, 'quantity' AS size_field, 'returnflag' AS md5_field,
        array('type', 'lineitem_id', 'orderkey', 'linenumber', 'scan', 'internal_file_name', 'quantity', 'returnflag',
              'order.order_id', 'part.part_id', 'supplier.supplier_id') AS header,
        array('lineitem', {v['given_id']}, CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), {v['scan_cell']},
              {v['inner_cell']}, {v['size_cell']}, l_returnflag, CAST(l_orderkey AS STRING), {v['part_cell']},
              {v['supplier_cell']}) AS cells
      FROM lineitem""")


# Documents as data files: what the records say, and what is in storage.
FILE_SQL = """
  SELECT 'doc:' || CAST(doc_id AS STRING) AS record_id, 'S' || CAST(doc_id % 4 AS STRING) AS submission_id,
         doc_id % 41 <> 0 AS has_info,
         CASE WHEN doc_id % 19 = 0 THEN 'shared' || CAST(doc_id % 57 AS STRING) ELSE 'doc_' || CAST(doc_id AS STRING) END
           || '.txt' AS file_name,
         n_chars AS size, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE md5(text) END AS md5, 'New' AS file_status, doc_id
  FROM documents
"""
LISTING_SQL = """
  SELECT submission_id, file_name, 'root/' || submission_id || '/file/' || file_name AS path, actual_size, actual_md5,
         CAST('2024-01-0' || CAST(first_doc % 9 + 1 AS STRING) AS TIMESTAMP) AS modified_at, first_doc
  FROM (
    SELECT 'S' || CAST(doc_id % 4 AS STRING) AS submission_id,
           CASE WHEN doc_id % 19 = 0 THEN 'shared' || CAST(doc_id % 57 AS STRING) ELSE 'doc_' || CAST(doc_id AS STRING) END
             || '.txt' AS file_name,
           min(doc_id) AS first_doc,
           min(n_chars + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END) AS actual_size,
           min(CASE WHEN doc_id % 29 = 0 THEN md5('other') ELSE md5(text) END) AS actual_md5
    FROM documents WHERE doc_id % 31 <> 0 GROUP BY 1, 2
    UNION ALL
    SELECT 'S' || CAST(doc_id % 4 AS STRING), CASE WHEN doc_id % 101 = 0 THEN 'log/' ELSE '' END ||
           CASE WHEN doc_id % 2 = 0 THEN 'extra_' ELSE 'orphan_' END || CAST(doc_id AS STRING), doc_id, n_chars, md5(text)
    FROM documents WHERE doc_id % 17 = 0) AS found
"""
CACHE_SQL = """
  SELECT 'S' || CAST(doc_id % 4 AS STRING) AS submission_id, 'doc_' || CAST(doc_id AS STRING) || '.txt' AS file_name,
         md5(text) AS md5, CAST('2024-01-05' AS TIMESTAMP) AS modified_at
  FROM documents WHERE doc_id % 3 = 0
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    star.tables(spark, sf_dir, "documents")
    return spark.sql(FILE_SQL)


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    codes = (
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("-1")))
        .when(F.col("doc_id") % 5 == 1, F.array(F.lit("1"), F.lit("-1")))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.select(
        "record_id", "submission_id", F.lit("DC").alias("data_commons"), F.lit("document").alias("node_type"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("dg.4DFC/"), F.col("doc_id"))).otherwise(
            F.col("doc_id").cast("string")).alias("node_id"),
        F.when(F.col("has_info"), F.struct("file_name", "size", "md5", F.col("file_status").alias("status"))).alias("file_info"),
        codes.alias("consent_codes"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    star.tables(spark, sf_dir, "documents")
    return spark.sql(LISTING_SQL)


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    star.tables(spark, sf_dir, "documents")
    return spark.sql(CACHE_SQL)


def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventeenth document names its extra file in two batches."""
    star.tables(spark, sf_dir, "documents")
    return spark.sql("""
      SELECT 'u' || CAST(doc_id AS STRING) || '_' || CAST(n AS STRING) AS batch_id,
             'S' || CAST(doc_id % 4 AS STRING) AS submission_id,
             CASE WHEN doc_id % 85 = 0 THEN 'metadata' ELSE 'data file' END AS type,
             CASE WHEN n = 2 THEN 'Failed' ELSE 'Uploaded' END AS status, doc_id * 10 + n AS display_id,
             array('x', CASE WHEN doc_id % 2 = 0 THEN 'extra_' ELSE 'orphan_' END || CAST(doc_id AS STRING)) AS files
      FROM documents LATERAL VIEW explode(array(0, 1, 2)) v AS n WHERE doc_id % 34 = 0""")


DUMP_SQL = """
  SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'null' WHEN p_partkey % 19 = 0 THEN ''
                         ELSE 'E' || CAST(p_partkey % 300 AS STRING) END AS CDECode,
         CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE '1.' || CAST(p_partkey % 3 AS STRING) END AS CDEVersion,
         p_name AS CDEFullName,
         array(
           named_struct('value', CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN 'https://x/' || p_brand
                                      ELSE p_brand || ' ' END,
                        'ncit_concept_code', CASE WHEN p_partkey % 5 <> 0 THEN 'C' || CAST(p_size AS STRING) END,
                        'synonyms', CASE WHEN p_partkey % 6 = 0 THEN CAST(array() AS ARRAY<STRING>)
                                         ELSE array(lower(p_brand), '') END),
           named_struct('value', CASE WHEN p_partkey % 29 <> 0 THEN p_type END, 'ncit_concept_code', 'K' || p_type,
                        'synonyms', array(p_name))) AS permissibleValues
  FROM part
"""


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    star.tables(spark, sf_dir, "part")
    return spark.sql(DUMP_SQL)


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a raw property definition."""
    star.tables(spark, sf_dir, "part")
    return spark.sql("""
      SELECT 'DC' AS data_commons, CAST(p_partkey % 3 AS STRING) AS model_version, 'n' || CAST(p_size AS STRING) AS node_type,
        'p' || CAST(p_partkey AS STRING) AS prop,
        CASE p_partkey % 8 WHEN 0 THEN 'integer' WHEN 1 THEN 'Number' WHEN 2 THEN 'date' END AS kind,
        CASE p_partkey % 8 WHEN 3 THEN 'list' WHEN 4 THEN 'number' END AS value_type,
        CASE WHEN p_partkey % 8 = 5 THEN '^' || p_brand END AS pattern,
        CASE WHEN p_partkey % 8 = 6 THEN array(p_type, 'http://kept') END AS listing,
        CASE WHEN p_partkey % 8 IN (3, 4) THEN array('http://gone', p_brand) END AS enum,
        CASE WHEN p_partkey % 8 = 4 THEN array('mg', p_type, 'mg') END AS units,
        CASE p_partkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'Preferred' END AS required,
        CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS minimum,
        CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size + 100 AS DOUBLE) END AS maximum,
        CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size + 1 AS DOUBLE) END AS exclusive_minimum,
        CASE WHEN p_partkey % 11 = 0 THEN CAST(p_size + 99 AS DOUBLE) END AS exclusive_maximum,
        array(named_struct('Code', 'X', 'Version', '0', 'Origin', 'NCIt'),
              named_struct('Code', 'D' || CAST(p_partkey AS STRING), 'Version', '1.00',
                           'Origin', CASE WHEN p_partkey % 13 = 0 THEN 'caDSR II' ELSE NULL END)) AS terms
      FROM part""")
