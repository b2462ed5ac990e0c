from __future__ import annotations

import os

from pyspark.sql import functions as F

from tabgate.operators import export as O
from tabgate.schema import EDGES


def test_tables_of_all_types_are_written_in_one_go(spark, tmp_path):
    rows = spark.sql("""
      SELECT * FROM VALUES ('a', map('type', 'a', 'a_id', '1', 'z', 'tab\\there', 'b', 'say "hi"')),
        ('a', map('type', 'a', 'a_id', '2', 'y', 'two\\nlines')), ('a', map('type', 'a', 'a_id', '2', 'y', 'two\\nlines')),
        ('b', map('type', 'b', 'q', CAST(NULL AS STRING), 'b_id', ' x ')), ('c', map('type', 'c', 'k', '')),
        (CAST(NULL AS STRING), map('type', 'n')), ('', map('type', 'e')) AS t(node_type, columns)""")
    nodes = spark.createDataFrame([("a", "a_id"), ("b", "b_id"), ("unused", "u")], "node_type string, id_prop string")
    folder = str(tmp_path / "out")
    O.write_tables(rows, nodes, folder, rows_per_file=1)
    assert sorted(n for n in os.listdir(folder) if "=" in n) == ["node_type=a", "node_type=b", "node_type=c"]
    assert len(os.listdir(f"{folder}/node_type=a")) >= 2
    a, b, c = (O.read_table(spark, folder, t) for t in "abc")
    assert (a.columns, b.columns, c.columns) == (["type", "a_id", "b", "y", "z"], ["type", "b_id", "q"], ["type", "k"])
    assert sorted(map(tuple, a.collect()), key=str) == sorted(
        [("a", "1", 'say "hi"', None, "tab\there"), *[("a", "2", None, "two\nlines", None)] * 2], key=str)
    assert [tuple(r) for r in b.collect()] == [("b", " x ", None)] and [tuple(r) for r in c.collect()] == [("c", None)]


def test_nothing_to_write(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS node_type, map('type', 'a') AS columns").limit(0)
    nodes = spark.createDataFrame([("a", "a_id")], "node_type string, id_prop string")
    O.write_tables(rows, nodes, str(tmp_path / "out"))
    assert [n for n in os.listdir(tmp_path / "out") if "=" in n] == []


def records_to_export(spark):
    texts = "map<string,string>"
    return spark.createDataFrame([
        ("plain", "a", "G1", {"a_id": "1", "x": "True"}, [("b", "b_id", "7"), ("c", "c_id", None)], {"made": "False"}),
        ("clash", "a", "G2", {"type": "own", "global_id": "own", "made": "own", "b.b_id": "own", "y": "True "},
         [("b", "b_id", "7"), ("b", "other", "8"), ("c", "c_id", "9")], {"made": "new"}),
        ("side", "d", "G3", {"global_id": "own", "z": None}, [], None),
        ("empty", "a", None, None, [("b", "b_id", "True"), ("b", "b_id", "x")], None),
    ], f"record_id string, node_type string, global_id string, props {texts}, parents {EDGES}, generated_props {texts}"
    ).withColumns({"data_commons": F.lit("D"), "model_version": F.lit("1")})


def test_columns_and_their_names(spark):
    nodes = spark.createDataFrame(
        [("D", "1", "a", True), ("D", "1", "d", False)],
        "data_commons string, model_version string, node_type string, is_main boolean")
    rows = O.export_rows(records_to_export(spark), nodes)
    got = {r["record_id"]: r["columns"] for r in rows.collect()}
    assert got == {
        "plain": {"a_id": "1", "x": "true", "type": "a", "global_id": "G1", "made": "false", "b.b_id": "7", "c.c_id": ""},
        "clash": {"y": "True ", "type": "a", "global_id": "G2", "made": "new", "b.b_id": "7 | 8", "c.c_id": "9"},
        "side": {"z": None, "type": "d"},
        "empty": {"type": "a", "b.b_id": "True | x"},
    }
    for r in rows.collect():
        assert sorted(r["names"]) == sorted(r["columns"])


def test_parents_are_made_once_a_record_and_not_for_names(spark):
    nodes = spark.createDataFrame(
        [("D", "1", "a", True)], "data_commons string, model_version string, node_type string, is_main boolean")
    rows = O.export_rows(records_to_export(spark), nodes)

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    # Once for a record, not once more for each of its properties, and the names need no cells.
    assert plan(rows.select("columns")).count("map_from_entries") == 1
    assert "transform_values" not in plan(rows.select("node_type", "names"))
