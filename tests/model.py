"""A small model and record builder for the fixtures."""

from __future__ import annotations

import json

from tabgate.schema import EDGES, MODEL_NODES, MODEL_PROPS, MODEL_RELS, local_table

RECORD = (
    "record_id STRING, submission_id STRING, data_commons STRING, model_version STRING, study_id STRING, status STRING,"
    " file_name STRING, line_number INT, node_type STRING, node_id STRING, id_prop STRING, props MAP<STRING, STRING>,"
    f" parents {EDGES}, entity_type STRING"
)


def record(record_id="r1", **over) -> dict:
    base = {
        "record_id": record_id, "submission_id": "s1", "data_commons": "dc", "model_version": "1", "study_id": "t1",
        "status": "New", "file_name": "f.tsv", "line_number": 2, "node_type": "sample", "node_id": "a",
        "id_prop": "sample_id", "props": {"sample_id": "a", "kind": "x"}, "parents": [], "entity_type": None,
    }
    return {**base, **over}


def records(spark, *rows):
    return local_table(spark, list(rows), RECORD)


def edge(kind, prop, value):
    return {"parent_type": kind, "parent_id_prop": prop, "parent_id_value": value}


def node(kind, id_prop, **over):
    base = {"data_commons": "dc", "model_version": "1", "node_type": kind, "ordinal": 0, "id_prop": id_prop,
            "comp_key": None, "is_file": False, "name_field": None, "size_field": None, "md5_field": None,
            "is_main": False, "entity_type": None}
    return {**base, **over}


def prop(kind, name, type_="string", required=False, **over):
    base = {"data_commons": "dc", "model_version": "1", "node_type": kind, "prop": name, "type": type_,
            "required": required, "min": None, "min_exclusive": None, "max": None, "max_exclusive": None,
            "pattern": None, "pvs": None, "cde_code": None, "cde_version": None}
    return {**base, **over}


def rel(kind, parent, multiplicity="many_to_one"):
    return {"data_commons": "dc", "model_version": "1", "node_type": kind, "parent_type": parent,
            "multiplicity": multiplicity}


def model(spark, nodes, props, rels=()):
    return (
        local_table(spark, nodes, MODEL_NODES), local_table(spark, props, MODEL_PROPS),
        local_table(spark, list(rels), MODEL_RELS),
    )


def rows(df, *columns):
    """The chosen columns as sorted tuples, nulls first."""
    got = [tuple(json.loads(json.dumps(r[c], default=str)) for c in columns) for r in df.collect()]
    return sorted(got, key=lambda t: [(v is not None, v) for v in t])
