"""What must not grow faster than the input: which rows are moved or stored on the way to a result."""

from __future__ import annotations

from pyspark.sql import functions as F

from model import model, node, prop, record, records, rows
from tabgate.operators import delete as D
from tabgate.operators import export as O
from tabgate.operators import properties as P
from tabgate.operators import relations as R
from tabgate.operators import release_checks as X
from tabgate.functions import text, typed
from tabgate.plans import check_queries, load_queries, star
from tabgate.session import even_reads

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_dealt_by_submission(spark):
    """Registered names are a row per submission, so cells don't move to meet them."""
    assert "hashpartitioning(submission_id" not in plan_of(check_queries.named(spark, FOLDER))


def test_records_are_stored_without_being_moved(spark):
    """Small source tables are dealt out before anything is made of them."""
    assert "hashpartitioning(record_id" not in plan_of(star.records(spark, FOLDER))
    assert "hashpartitioning(l_orderkey" in plan_of(star.records(spark, FOLDER, ("lineitem",)))


def test_candidates_are_made_from_the_rows_themselves(spark):
    """Only what is read is made: no wide table in between."""
    read = load_queries.candidates(spark, FOLDER).select("line_number")
    assert any(f.endswith("lineitem.parquet") for f in read.inputFiles())


def test_links_of_leaves_are_not_walked(spark):
    schema = "submission_id STRING, data_commons STRING, node_type STRING, node_id STRING, parents ARRAY<STRUCT<parent_type: STRING, parent_id_prop: STRING, parent_id_value: STRING>>"
    rows = spark.createDataFrame([
        ("S", "DC", "file", "f1", [("sample", "id", "s1")]), ("S", "DC", "file", "f2", [("sample", "id", "s1")]),
        ("S", "DC", "sample", "s1", [("group", "id", "g1")]), ("S", "DC", "group", "g1", []),
    ], schema)
    here, before = R.parent_links(rows, rows.limit(0))
    assert {r["parent_type"] for r in here.collect()} == {"sample"} and before.isEmpty()


def test_cascade_moves_only_records_a_level_leads_to(spark, monkeypatch):
    stored = []

    def kept(df, label, stage=D.stage):
        out = stage(df, label)
        stored.append((label, out.count()))
        return out

    monkeypatch.setattr(D, "stage", kept)
    schema = "record_id STRING, submission_id STRING, node_type STRING, node_id STRING, parents ARRAY<STRUCT<parent_type: STRING, parent_id_prop: STRING, parent_id_value: STRING>>"
    rows = spark.createDataFrame(
        [("a", "S", "a", "1", []), ("b", "S", "b", "1", [("a", "id", "1")]), ("c", "S", "c", "1", [("b", "id", "1"), ("z", "id", "9")])]
        + [(f"o{n}", "S", "b", f"o{n}", [("a", "id", "2")]) for n in range(50)], schema)
    found = {r["record_id"]: r["action"] for r in D.cascade(rows, rows.filter("record_id = 'a'")).collect()}
    assert found == {"a": "deleted", "b": "deleted", "c": "updated"}
    assert [n for label, n in stored if label == "touched"] == [1, 1, 0]


def test_export_reads_rows_twice_and_keeps_one_head_per_type(spark, tmp_path, monkeypatch):
    stored = {}

    def kept(df, label, stage=O.stage):
        stored[label] = stage(df, label)
        return stored[label]

    monkeypatch.setattr(O, "stage", kept)
    rows = spark.createDataFrame([("a", {"type": "a", "k": str(n)}) for n in range(9)] + [("b", {"type": "b", "x": "1"})],
                                 "node_type STRING, columns MAP<STRING,STRING>")
    nodes = spark.createDataFrame([("a", "k"), ("b", "k")], "node_type STRING, id_prop STRING")
    O.write_tables(rows, nodes, str(tmp_path / "out"), rows_per_file=2)
    assert stored["export-shapes"].count() == 2 and stored["export-heads"].count() == 2
    back = O.read_table(spark, str(tmp_path / "out"), "a")
    assert back.columns == ["type", "k"] and back.count() == 9


def test_cells_carry_no_lists(spark):
    """Vocabularies are looked up in the term index; no cell has a copy of its own."""
    assert "pvs" not in check_queries.cells(spark, FOLDER).columns


def test_release_check_meets_only_compared_records(spark):
    nodes, props, _ = model(spark, [node("sample", "sample_id")], [prop("sample", "sample_id")])
    given = records(spark, record("r1", node_id="a"), record("r2", node_id="b", props={"sample_id": "b"}),
                    record("r3", submission_id="s2", node_id="a"), record("r4", submission_id="s2", node_id="c"))
    releases = records(spark, record("x", node_id="a")).withColumnRenamed("record_id", "release_id").withColumn(
        "status", F.lit("Released"))
    subs = spark.createDataFrame([("s1", "New/Update"), ("s2", "Delete")], "submission_id STRING, intention STRING")
    assert {r["record_id"] for r in X.compared(given, releases, subs).collect()} == {"r1", "r4"}
    fixes = spark.createDataFrame([("r1", "kind", "y"), ("r2", "kind", "y")], "record_id STRING, prop STRING, new_value STRING")
    facts = P.node_facts(nodes, props)
    assert rows(X.release_issues(given, releases, subs, facts), "record_id", "code") == [("r4", "M019")]
    assert rows(X.release_issues(given, releases, subs, facts, fixes), "record_id", "code") == [("r1", "M018"), ("r4", "M019")]


def test_pardon_needs_no_records(spark):
    """Issues that carry their data commons meet the releases without the records."""
    issues = spark.createDataFrame(
        [("s1", "r1", "sample", "a", "M003", "dc"), ("s1", "r2", "sample", "b", "M003", "dc"), ("s1", "r1", "sample", "a", "M010", None)],
        "submission_id STRING, record_id STRING, node_type STRING, node_id STRING, code STRING, data_commons STRING")
    releases = records(spark, record("x", node_id="a")).withColumnRenamed("record_id", "release_id").withColumn(
        "status", F.lit("Released"))
    subs = spark.createDataFrame([("s1", "New/Update")], "submission_id STRING, intention STRING")
    left = X.without_pardoned(issues, None, releases, subs)
    assert rows(left, "record_id", "code") == [("r1", "M010"), ("r2", "M003")]


def test_only_text_and_booleans_meet_the_vocabulary_for_corrections(spark):
    """Numbers keep their value, so they are left out before the look-up."""
    terms = check_queries.context(spark, FOLDER)[1].index
    named = check_queries.named(spark, FOLDER)
    plan = P.corrections(P.with_terms(named, terms), P.list_terms(named, terms).limit(0))
    assert "type#" in plan_of(plan) and " IN (string,boolean)" in plan_of(plan)


def test_cell_checks_are_small_enough_to_be_compiled(spark):
    """HotSpot leaves methods of more than 8,000 bytes to its interpreter; registered names meet only the cells they are about."""
    named = check_queries.named(spark, FOLDER)
    matched = P.with_terms(P.with_parsed(named), check_queries.context(spark, FOLDER)[1].index)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = matched.select("*")._jdf.queryExecution().debug().codegenToSeq()
        parts = [found.apply(i) for i in range(found.size())]
        # One part makes the few cells of registered names, the other all the rest.
        assert min(p._3().maxMethodCodeSize() for p in parts if "explode(props" in p._1()) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_small_files_are_read_by_their_size(spark, tmp_path):
    """The few files with most rows don't come to one task."""
    folder = str(tmp_path / "rows")
    for n, (rows_, files) in enumerate(((400_000, 4), (400, 40))):
        spark.range(rows_).select(F.xxhash64("id")).repartition(files).write.parquet(f"{folder}/part={n}")
    even_reads(spark)
    sizes = spark.read.parquet(folder).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 200_000


def test_stripped_values_and_numbers(spark):
    """Looking at both ends first changes nothing."""
    given = ["", " ", "a", " a", "a ", "\u00a0a", "a\u3000", "~a!", "a b", "\x7fa", "é", " é", "\x1fa\x85", "!", None]
    rows_ = spark.createDataFrame([(v,) for v in given], "v STRING")
    assert [r[0] for r in rows_.select(text.strip(F.col("v"))).collect()] == [v if v is None else v.strip(text.SPACES) for v in given]
    numbers = spark.createDataFrame([(v,) for v in ("+007", "-0", "00", " 1_000 ", "-012", "+", "1__0", None)], "v STRING")
    assert [r[0] for r in numbers.select(typed.integer_text(F.col("v"))).collect()] == ["7", "0", "0", "1000", "-12", None, None, None]


def kept_stages(monkeypatch, module):
    """What a module stores, by label."""
    stored = {}

    def kept(df, label, stage=module.stage):
        stored[label] = stage(df, label)
        return stored[label]

    monkeypatch.setattr(module, "stage", kept)
    return stored


def test_only_types_looked_for_are_asked_for_parents(spark, monkeypatch):
    """Records that are nobody's parent, such as files, don't travel to the parents looked for."""
    stored = kept_stages(monkeypatch, R)
    given = records(spark, record("r1", node_id="a", props={"sample_id": "a", "other": "b"}), record("r2", node_type="file", node_id="f", props={"file_id": "f"}))
    keys = spark.createDataFrame([("s1", "dc", "sample", "sample_id", "a", 1), ("s1", "dc", "sample", "other", "a", 1), ("s1", "dc", "sample", "sample_id", "z", 1)],
                                 "submission_id STRING, data_commons STRING, parent_type STRING, parent_id_prop STRING, parent_id_value STRING, n_edges BIGINT")
    released = records(spark, record("x", node_id="z")).limit(0)
    found = R.present_parents(keys, given, released)
    assert rows(found, "parent_id_prop", "parent_id_value", "present") == [("other", "a", False), ("sample_id", "a", True), ("sample_id", "z", False)]
    assert [r[0] for r in stored["parent-types"].collect()] == ["sample"]
    released = records(spark, record("x", node_id="z"))
    assert rows(R.present_parents(keys, given, released), "parent_id_value", "present") == [("a", False), ("a", True), ("z", True)]


def test_records_are_not_sent_to_the_facts_of_their_types(spark):
    """Node facts are a few rows of known size: were the records the smaller side to the planner, one task would make all cells."""
    found = check_queries.cells(spark, FOLDER).filter("has_rule IS NULL")
    found.collect()  # sizes change while the plan runs
    assert "BuildRight" in plan_of(found) and "BuildLeft" not in plan_of(found)


def test_pardoned_issues_look_at_all_cells_once(spark):
    assert "explode(props" not in plan_of(check_queries.pardoned(spark, FOLDER))


def test_issues_are_made_of_failing_rows_only(spark):
    """The conditions come first and are compiled; the lists of issues, which are not, are made where one holds."""
    named = check_queries.named(spark, FOLDER)
    matched = P.with_terms(P.with_parsed(named), check_queries.context(spark, FOLDER)[1].index)
    found = P.cell_issues(matched, P.required_faults(), P.name_faults(), P.type_faults(), P.vocabulary_faults())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(filter(array" not in plan and "Filter (size(CASE" not in plan
    assert plan.count("filter(array(") == 1


def test_list_cells_are_made_once_and_of_types_with_lists(spark, monkeypatch):
    stored = kept_stages(monkeypatch, P)
    given, (ctx, ready) = check_queries.records(spark, FOLDER), check_queries.context(spark, FOLDER)
    kinds = P.with_lists(given, ready.rules).select("node_type").distinct()
    assert sorted(r[0] for r in kinds.collect()) == ["order", "part"]
    lists = check_queries.validate.list_cells(given, ctx, ready)
    assert "explode(props" not in plan_of(lists)
    assert lists.count() == stored["lists"].count() > 0


def test_concept_cells_are_made_once(spark):
    assert "explode(props" not in plan_of(check_queries.concept_codes(spark, FOLDER))


def test_parents_of_different_kinds_are_not_looked_at_one_by_one(spark):
    """Two parents of one kind among three: all edges of that record are looked at, no edge of others."""
    given, (ctx, _) = check_queries.records(spark, FOLDER), check_queries.context(spark, FOLDER)
    plan = R.several_parents(given, ctx.model_nodes, ctx.model_props, ctx.model_rels)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(array_distinct" in plan


def test_consent_codes_of_files_are_those_of_what_they_reach(spark, monkeypatch):
    """Codes join the nodes above files, not the files; a group reached twice counts once, two groups of one code twice."""
    def rec(kind, ident, *parents, **over):
        return record(f"{kind}:{ident}", node_type=kind, node_id=ident, parents=[
            {"parent_type": p, "parent_id_prop": f"{p}_id", "parent_id_value": v} for p, v in parents], **over)

    kinds = spark.createDataFrame([("dc", "1", "file")], "data_commons STRING, model_version STRING, node_type STRING")
    given = records(
        spark, rec("file", "twice", ("case", "a"), ("case", "b")), rec("file", "same", ("case", "a"), ("case", "c")),
        rec("file", "mixed", ("case", "a"), ("case", "o")), rec("file", "blank", ("case", "n")), rec("file", "gone", ("case", "x")),
        rec("case", "a", ("group", "1")), rec("case", "b", ("group", "1")), rec("case", "c", ("group", "2")),
        rec("case", "o", ("group", "3")), rec("case", "n", ("group", "4"), ("group", "5")),
        rec("group", "1", props={"number": "7"}), rec("group", "2", props={"number": "7"}), rec("group", "3", props={"number": "-1"}),
        rec("group", "4", props={"number": ""}))
    released = records(spark, record("x", node_id="z")).limit(0).withColumn("release_id", F.col("record_id"))
    stored = kept_stages(monkeypatch, R)
    codes = R.file_consent_codes(given, released, kinds, "group", "number")
    assert rows(codes, "record_id", "codes", "conflict") == [
        ("file:blank", [], False), ("file:mixed", [], True), ("file:same", ["7", "7"], False), ("file:twice", ["7"], False)]
    assert "reach" not in stored
    again = R.consent_codes(R.consent_reach(given, released, kinds, "group"), given, released, "group", "number")
    assert rows(again, "record_id", "codes", "conflict") == rows(codes, "record_id", "codes", "conflict")


def test_recommendations_are_compiled(spark):
    """A filter on the advice repeated the text of a number at every place, in more than 64 KB of code that the JVM refuses."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert check_queries.recommendations(spark, FOLDER).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_parents_that_lead_nowhere_are_not_walked(spark, monkeypatch):
    """Files name nodes of a type without parents: these are neither counted nor climbed from."""
    def rec(kind, ident, *parents):
        return record(f"{kind}:{ident}", node_type=kind, node_id=ident, parents=[
            {"parent_type": p, "parent_id_prop": f"{p}_id", "parent_id_value": v} for p, v in parents])

    kinds = spark.createDataFrame([("dc", "1", "file")], "data_commons STRING, model_version STRING, node_type STRING")
    given = records(
        spark, rec("file", "f", ("case", "a"), ("part", "p"), ("old", "o")), rec("part", "p"), rec("case", "a", ("group", "1")))
    released = records(spark, rec("old", "o", ("group", "2"))).withColumn("release_id", F.col("record_id"))
    stored = kept_stages(monkeypatch, R)
    reach = R.consent_reach(given, released, kinds, "group")
    assert rows(reach, "record_id", "group_id") == [("file:f", "1"), ("file:f", "2")]
    assert rows(stored["file-parents"], "parent_type") == [("case",), ("old",)]


def test_cascade_result_needs_no_records(spark, tmp_path):
    """Parents travel with the records that a level leads to, so all records are not moved once more to the affected ones."""
    schema = "record_id STRING, submission_id STRING, node_type STRING, node_id STRING, parents ARRAY<STRUCT<parent_type: STRING, parent_id_prop: STRING, parent_id_value: STRING>>"
    spark.createDataFrame(
        [("a", "S", "a", "1", []), ("b", "S", "b", "1", [("a", "id", "1")]), ("n", "S", "n", "1", None),
         ("c", "S", "c", "1", [("b", "id", "1"), ("z", "id", "9"), ("b", "id", "2")])], schema).write.parquet(str(tmp_path / "records"))
    given = spark.read.schema(schema).parquet(str(tmp_path / "records"))
    for by, left in (("type", ["9"]), ("id", ["9", "2"])):
        found = D.cascade(given, given.filter("record_id = 'a'"), by=by)
        assert rows(found, "record_id", "action", "n_parents_left") == [("a", "deleted", None), ("b", "deleted", None), ("c", "updated", len(left))]
        assert [[p["parent_id_value"] for p in r["parents"]] for r in found.filter("action = 'updated'").collect()] == [left]
        assert not any("/records/" in f for f in found.inputFiles())
