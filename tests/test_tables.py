from __future__ import annotations

import hashlib
import random
import uuid

from model import edge, rows
from pyspark.sql import functions as F

from tabgate.functions import ids, text
from tabgate.operators import files as H
from tabgate.operators import release as J
from tabgate.operators.lookup import attach, counted
from tabgate.schema import EDGES, local_table
from tabgate.sources import listing, tsv


def test_attach_gives_the_plain_join_with_and_without_heavy_keys(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    facts = counted(df.filter("k IS NOT NULL AND k <> '4'"), ["k"], name="n").withColumn("v", F.concat(F.lit("v"), "k"))
    want = rows(df.join(facts, "k", "left"), "id", "n", "v")
    for heavy in (100, 10**9):
        assert rows(attach(df, facts, ["k"], "n", ["id"], heavy_rows=heavy), "id", "n", "v") == want


def test_deeper_chains_than_the_model_has_types(spark):
    from tabgate.operators.frontier import walk

    links = spark.range(40).select(F.col("id").alias("n"), ((F.col("id") + 1) % 40).alias("up"))
    found = walk(spark.range(1).select(F.col("id").alias("n")), lambda level: level.join(links, "n").select(F.col("up").alias("n")), ["n"])
    assert found.count() == 40


def test_numbers_and_integers_as_text(spark):
    from tabgate.functions import typed

    texts = ["1e30", "inf", "-Infinity", "nan", "0.12345678901", "12.50", "1_000", "1e-12", "-0.0", "100", "123456789.5", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(typed.number_text(typed.as_number(F.col("t")))).collect()]
    assert got == ["1e30", "inf", "-inf", "nan", "0.12345678901", "12.5", "1000", "1e-12", "0", "100", "123456789.5", None]
    long = "9" * 40
    df = spark.createDataFrame([(t,) for t in (long, "-00" + long, "+007", "1_0", "-0", "x")], "t STRING")
    assert [r[0] for r in df.select(typed.integer_text(F.col("t"))).collect()] == [long, "-" + long, "7", "10", "0", None]


def test_patterns_are_judged_by_the_engine_that_matches(spark):
    from tabgate.operators.rules import with_pattern_state

    patterns = ["[A-Z]+", "(un(closed", "[[]a", "(a)(?(1)b|c)", "(?P<n>x)", None]
    df = spark.createDataFrame([(p,) for p in patterns], "pattern STRING")
    assert [r["pattern_ok"] for r in with_pattern_state(df).collect()] == [True, False, False, False, True, False]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    names = {"a.tsv": 4000, "b.tsv": 3}
    for name, n in names.items():
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * (i % 90)}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = tsv.text_lines(spark, str(tmp_path))
        assert lines.select("path", "block").distinct().count() > 10
        got = tsv.numbered(lines).select(
            F.get(F.split("value", " "), F.lit(1)).cast("int").alias("want"), "line_number", "file_name").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 4003 and all(r["want"] == r["line_number"] for r in got)


def test_cells_quotes_and_nulls(spark):
    lines = ['a\t"b\tc"\t', '\t" x ""y"" "\t  \tz', '"open\tq', '""\tlast']
    df = spark.createDataFrame([(n, v) for n, v in enumerate(lines)], "n INT, value STRING")
    got = dict((r["n"], r["c"]) for r in df.select("n", tsv.cells(F.col("value")).alias("c")).collect())
    assert got == {0: ["a", "b\tc", None], 1: [None, 'x "y"', "", "z"], 2: ['"open', "q"], 3: [None, "last"]}


def test_unreadable_files(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "wide.tsv").write_text("a\tb\n1\t2\n\n1\t2\t3\n")
    (tmp_path / "odd.tsv").write_bytes(b"a\tb\n1\t\xff\xfe\n")
    lines = tsv.parsed(tsv.numbered(tsv.text_lines(spark, str(tmp_path))))
    (tmp_path / "void.tsv").write_text("")
    expected = spark.createDataFrame(
        [("good.tsv",), ("wide.tsv",), ("odd.tsv",), ("none.tsv",), ("void.tsv",)], "file_name STRING")
    stored = spark.createDataFrame([(p.name,) for p in tmp_path.iterdir()], "file_name STRING")
    assert rows(tsv.unreadable(lines, expected, stored).filter("kind = 'file not found'"), "file_name") == [("none.tsv",)]
    expected = expected.filter("file_name <> 'void.tsv'")
    assert rows(tsv.unreadable(lines, expected), "file_name", "line_number", "kind") == [
        ("none.tsv", None, "file not found"), ("odd.tsv", 2, "non UTF-8 character(s) found"),
        ("wide.tsv", 4, "Expected 2 fields saw 3")]


def test_listing_and_checksums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "small.bin").write_bytes(b"abc")
    (tmp_path / "large.bin").write_bytes(b"x" * 5000)
    assert rows(listing.listed(spark, str(tmp_path)), "file_name", "size") == [("large.bin", 5000), ("small.bin", 3)]
    got = {r["path"].split("/")[-1]: r["md5"] for r in listing.hashed(spark, str(tmp_path), one_cell=100).collect()}
    assert got == {"small.bin": hashlib.md5(b"abc").hexdigest(), "large.bin": hashlib.md5(b"x" * 5000).hexdigest()}


def test_identifiers(spark):
    site, study, path = "https://hub.example.org/", "st-é", "dir/ä.txt"
    want = "dg.4DFC/" + str(uuid.uuid5(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, site), study), path))
    row = spark.range(1).select(
        ids.stable_file_id(site, F.lit(study), F.lit(path)).alias("id"),
        ids.file_id_case(F.lit("DG.4dfc/ABC")).alias("cased"),
        ids.composite_id(F.lit(" "), F.array(F.lit(" a "), F.lit(None).cast("string"))).alias("half"),
        ids.composite_id(F.lit(None).cast("string"), F.array(F.lit(None).cast("string"), F.lit(""))).alias("none"),
        text.size_text(F.lit(1536)).alias("kb"), text.size_text(F.lit(0)).alias("zero"), text.size_text(F.lit(10)).alias("b"),
    ).first()
    assert row.asDict() == {"id": want, "cased": "dg.4DFC/abc", "half": "a_", "none": "", "kb": "1.5 KB", "zero": "0B", "b": "10.0 B"}


def brute_parents(new, old, kinds):
    if not old:
        return new
    merged = [dict(p) for p in old]
    for p in new:
        if p in merged:
            continue
        same = [q for q in merged if q["parent_type"] == p["parent_type"]]
        if kinds.get(p["parent_type"]) == "many_to_many" or not same:
            merged.append(dict(p))
        else:
            same[0]["parent_id_value"] = p["parent_id_value"]
    return merged


def test_parent_merge_against_brute_force(spark):
    pick = random.Random(3)
    kinds = {"a": "many_to_many", "b": "many_to_one", "c": "one_to_one"}
    cases = []
    for n in range(60):
        def some():
            return [edge(pick.choice("abc"), "id", str(pick.randrange(4))) for _ in range(pick.randrange(5))]

        cases.append({"n": n, "new": some(), "old": some()})
    df = local_table(spark, cases, f"n INT, new {EDGES}, old {EDGES}")
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    got = df.select("n", J.merged_parents(F.col("new"), F.col("old"), known).alias("m")).collect()
    for r in got:
        case = cases[r["n"]]
        assert [p.asDict() for p in r["m"]] == brute_parents(case["new"], case["old"], kinds), case


def test_property_merge(spark):
    new, old = {"a": "1", "b": " ", "c": "", "d": " <Delete> ", "e": None}, {"a": "0", "b": "kept", "e": "too", "z": "lost"}
    df = local_table(spark, [{"n": 1, "new": new, "old": old}], "n INT, new MAP<STRING,STRING>, old MAP<STRING,STRING>")
    row = df.select(
        J.merged_props(F.col("new"), F.col("old"), F.lit(True)).alias("m"),
        J.merged_props(F.col("new"), F.col("old"), F.lit(False)).alias("first")).first()
    assert row["m"] == {"a": "1", "b": "kept", "d": None, "e": "too"}
    assert row["first"] == {**new, "d": None}


def test_file_checks_in_order(spark):
    df = spark.createDataFrame(
        [("s", "1", False, None, None, None), ("s", "2", True, "n2", 0, "m"), ("s", "3", True, "n3", 1, "m3"),
         ("s", "4", True, "n4", 1, "m4"), ("s", "5", True, "n5", 2, "m5"), ("s", "6", True, "n6", 1, "same"),
         ("s", "7", True, "n6", 1, "same"), ("s", "8", True, "n8", 1, "m8"), ("s", "9", True, "n8", 1, "m9"),
         ("s", "10", True, "n10", 1, "twin"), ("s", "11", True, "n11", 1, "twin"), ("s", "12", True, "n12", 1, "m12"),
         ("t", "13", True, "n12", 1, "m12")],
        "submission_id STRING, record_id STRING, has_info BOOLEAN, file_name STRING, size BIGINT, md5 STRING")
    stored = spark.createDataFrame(
        [("s", f"n{n}", 1, m) for n, m in ((4, "other"), (5, "m5"), (6, "same"), (8, "m8"), (10, "twin"), (11, "twin"), (12, "m12"))]
        + [("t", "n12", 1, "m12")],
        "submission_id STRING, file_name STRING, actual_size BIGINT, actual_md5 STRING")
    assert sorted((int(r["record_id"]), r["code"]) for r in H.file_issues(df, stored).collect()) == [
        (1, "F009"), (2, "F010"), (3, "F001"), (4, "F004"), (5, "F003"), (6, "F005"), (7, "F005"), (8, "F006"), (9, "F004"),
        (10, "F007"), (11, "F007")]
