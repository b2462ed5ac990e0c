"""Schemas of the tables the jobs exchange."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

EDGE = "STRUCT<parent_type: STRING, parent_id_prop: STRING, parent_id_value: STRING>"
EDGES = f"ARRAY<{EDGE}>"
FILE_INFO = "STRUCT<file_name: STRING, size: BIGINT, md5: STRING, status: STRING>"
HISTORY = (
    "ARRAY<STRUCT<submission_id: STRING, intention: STRING, released_at: TIMESTAMP,"
    f" props: MAP<STRING, STRING>, parents: {EDGES}>>"
)

RECORDS = f"""
  record_id STRING, submission_id STRING, data_commons STRING, model_version STRING, study_id STRING,
  batch_ids ARRAY<STRING>, latest_batch_id STRING, latest_batch_display_id STRING,
  uploaded_date TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP, validated_at TIMESTAMP,
  status STRING, file_name STRING, line_number INT, node_type STRING, node_id STRING, id_prop STRING,
  props MAP<STRING, STRING>, parents {EDGES}, raw_data MAP<STRING, STRING>,
  generated_props MAP<STRING, STRING>, entity_type STRING, global_id STRING,
  file_info {FILE_INFO}, consent_codes ARRAY<STRING>, issue_id STRING
"""

RELEASES = f"""
  release_id STRING, submission_id STRING, data_commons STRING, study_id STRING, status STRING,
  node_type STRING, node_id STRING, global_id STRING, props MAP<STRING, STRING>, parents {EDGES},
  generated_props MAP<STRING, STRING>, entity_type STRING, data_file_location STRING,
  created_at TIMESTAMP, updated_at TIMESTAMP, history {HISTORY}
"""

MODEL_NODES = """
  data_commons STRING, model_version STRING, node_type STRING, ordinal INT, id_prop STRING,
  comp_key ARRAY<STRING>, is_file BOOLEAN, name_field STRING, size_field STRING, md5_field STRING,
  is_main BOOLEAN, entity_type STRING
"""

MODEL_PROPS = """
  data_commons STRING, model_version STRING, node_type STRING, prop STRING, type STRING,
  required BOOLEAN, min DOUBLE, min_exclusive BOOLEAN, max DOUBLE, max_exclusive BOOLEAN,
  pattern STRING, pvs ARRAY<STRING>, cde_code STRING, cde_version STRING
"""

MODEL_RELS = """
  data_commons STRING, model_version STRING, node_type STRING, parent_type STRING, multiplicity STRING
"""

ISSUES = """
  submission_id STRING, record_id STRING, node_type STRING, node_id STRING, code STRING,
  severity STRING, title STRING, offending_property STRING, offending_value STRING, description STRING
"""


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small rule table given in code; Catalyst knows its size and broadcasts it by itself."""
    return spark.sql(
        "SELECT inline(from_json(:rows, :shape))",
        args={"rows": json.dumps(rows), "shape": f"ARRAY<STRUCT<{_struct_fields(schema)}>>"},
    )


def _struct_fields(schema: str) -> str:
    fields, depth, start, text = [], 0, 0, " ".join(schema.split())
    for at, char in enumerate(text + ","):
        depth += (char in "<(") - (char in ">)")
        if char == "," and depth == 0:
            name, kind = text[start:at].strip().split(" ", 1)
            fields.append(f"{name}: {kind}")
            start = at + 1
    return ", ".join(fields)
