"""Metadata files made from the driver tables, with a different fault in every kind of file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgate.plans import star
from tabgate.schema import local_table

ROWS_PER_FILE = 50

# f: number of the file, i: row in the file, t: kind of fault.
CUSTOMER_LINES = """
  WITH k AS (SELECT *, c_custkey DIV 50 AS f, CAST(c_custkey % 50 AS INT) AS i, (c_custkey DIV 50) % 20 AS t FROM customer),
  heads AS (
    SELECT f, 1 AS line_number, concat(
      if(t = 5, array(), array('type')), if(t = 9, array(), array('customer_id')), array('name'),
      if(t = 11, array(), array('segment')),
      CASE WHEN t = 12 THEN array() WHEN t = 13 THEN array('galaxy.galaxy_id') WHEN t IN (14, 16) THEN array('part.part_id')
           WHEN t = 15 THEN array('nation.anthem') ELSE array('nation.nation_id') END,
      CASE t WHEN 2 THEN array(CAST(NULL AS STRING), NULL) WHEN 3 THEN array('name')
             WHEN 18 THEN array(CAST(NULL AS STRING), 'extra') ELSE array() END) AS cells
    FROM k WHERE i = 0),
  body AS (
    SELECT f, i + 2 AS line_number, CASE WHEN (t = 4 AND i = 7) OR (t = 0 AND i >= 45) THEN
      transform(sequence(1, 5), x -> CAST(NULL AS STRING)) ELSE concat(
      if(t = 5, array(), array(CASE WHEN t = 6 AND i = 9 THEN NULL WHEN t = 7 THEN 'galaxy'
                                    WHEN t = 8 AND i IN (3, 11) THEN 'order' ELSE 'customer' END)),
      if(t = 9, array(), array(CASE WHEN t = 10 AND i IN (5, 6) THEN NULL
                                    WHEN t IN (16, 17, 19) THEN CAST(c_custkey DIV 2 AS STRING)
                                    ELSE CAST(c_custkey AS STRING) END)),
      array(c_name), if(t = 11, array(), array(CASE WHEN t = 17 THEN 'same' ELSE c_mktsegment END)),
      CASE WHEN t = 12 THEN array() WHEN t = 17 THEN array(CAST(i AS STRING)) WHEN t = 19 THEN array('7')
           ELSE array(CAST(c_nationkey AS STRING)) END,
      CASE t WHEN 2 THEN array(CASE WHEN i % 10 = 0 THEN 'x' END, NULL) WHEN 3 THEN array('again')
             WHEN 18 THEN array(CAST(NULL AS STRING), 'e') ELSE array() END) END AS cells
    FROM k WHERE t <> 1)
  SELECT 'C' || CAST(f % 4 AS STRING) AS batch_id, 'customers_' || CAST(f AS STRING) || '.tsv' AS file_name,
         CAST(line_number AS INT) AS line_number, cells FROM (SELECT * FROM heads UNION ALL SELECT * FROM body)
"""

PART_LINES = """
  WITH k AS (SELECT *, p_partkey DIV 50 AS f, CAST(p_partkey % 50 AS INT) AS i, (p_partkey DIV 50) % 8 AS t,
                    md5(CAST(p_partkey AS STRING)) AS h FROM part),
  heads AS (
    SELECT f, t, 1 AS line_number, concat(array('type', 'lineitem_id', 'orderkey'), if(t = 4, array(), array('linenumber')),
      if(t = 6, array(), array('scan')), array('order.order_id')) AS cells FROM k WHERE i = 0),
  body AS (
    SELECT f, t, i + 2 AS line_number, concat(
      array('lineitem', CASE WHEN t IN (2, 3, 4) THEN NULL WHEN t = 1 AND i % 7 = 0 THEN 'not-an-id'
        ELSE 'DG.4dfc/' || upper(substr(h, 1, 8)) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' ||
             substr(h, 17, 4) || '-' || substr(h, 21, 12) END,
        CASE WHEN t = 3 AND i IN (4, 8) THEN NULL WHEN t = 4 AND i = 6 THEN NULL ELSE CAST(p_partkey AS STRING) END),
      if(t = 4, array(), array(CASE WHEN t = 3 AND i IN (4, 8) THEN NULL ELSE CAST(i AS STRING) END)),
      if(t = 6, array(), array(CASE WHEN t = 5 AND i % 9 = 0 THEN NULL ELSE 'scan' END)), array('1')) AS cells
    FROM k)
  SELECT 'P' || CAST(t AS STRING) AS batch_id, 'parts_' || CAST(f AS STRING) || '.tsv' AS file_name,
         CAST(line_number AS INT) AS line_number, cells FROM (SELECT * FROM heads UNION ALL SELECT * FROM body)
"""

BATCHES = [
    *[{"batch_id": f"C{n}", "submission_id": f"S{n}", "data_commons": "DC", "model_version": "1",
       "intention": "New/Update", "omit_prefix": False} for n in range(4)],
    *[{"batch_id": f"P{n}", "submission_id": f"S{n}", "data_commons": "DC", "model_version": "1",
       "intention": "Delete" if n >= 5 else "New/Update", "omit_prefix": False} for n in range(8)],
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    star.tables(spark, sf_dir, "customer", "part")
    return spark.sql(CUSTOMER_LINES).unionByName(spark.sql(PART_LINES))


def batches(spark: SparkSession) -> DataFrame:
    return local_table(
        spark, BATCHES,
        "batch_id STRING, submission_id STRING, data_commons STRING, model_version STRING, intention STRING,"
        " omit_prefix BOOLEAN",
    )


def written_lines(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The customers as text files of 1000 lines: header, quoted cells, spaces, empty cells, wide lines."""
    star.tables(spark, sf_dir, "customer")
    text = spark.sql(r"""
      SELECT file_no, line, value FROM (
        SELECT c_custkey DIV 1000 AS file_no, 0 AS line, concat_ws('\t', 'type', ' customer_id', 'name', 'segment') AS value
        FROM customer WHERE c_custkey % 1000 = 0
        UNION ALL
        SELECT c_custkey DIV 1000, CAST(c_custkey % 1000 AS INT) + 1, concat_ws('\t', 'customer', CAST(c_custkey AS STRING),
          CASE WHEN c_custkey % 11 = 0 THEN '"a\tb ""q"" "' WHEN c_custkey % 13 = 0 THEN '' ELSE c_name || '  ' END,
          c_mktsegment, CASE WHEN c_custkey % 997 = 5 THEN 'more' END)
        FROM customer)""")
    (
        text.repartition("file_no").sortWithinPartitions("file_no", "line")
        .select("file_no", "value").write.partitionBy("file_no").text(folder)
    )


def written_documents(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The documents as text files of 100 documents each."""
    star.tables(spark, sf_dir, "documents")
    text = spark.sql("SELECT doc_id DIV 100 AS bundle, doc_id, text AS value FROM documents")
    (
        text.repartition("bundle").sortWithinPartitions("bundle", "doc_id")
        .select("bundle", "value").write.partitionBy("bundle").text(folder)
    )


def number_in(path, name: str):
    return F.regexp_extract(path, f"{name}=([0-9]+)", 1).cast("bigint")
