from __future__ import annotations

import pytest
from model import model, node, prop, record, records, rows

from tabgate.operators import properties as P
from tabgate.operators import rules as R
from tabgate.schema import local_table

NODES = [node("sample", "sample_id"), node("bare", "bare_id")]
PROPS = [
    prop("sample", "sample_id", required=True),
    prop("sample", "kind", required=True),
    prop("sample", "count", "integer", min=1.0, max=0.0, max_exclusive=True),
    prop("sample", "ratio", "number", max=2.0, max_exclusive=True),
    prop("sample", "day", "date"),
    prop("sample", "flag", "boolean"),
    prop("sample", "code", "pattern", pattern="[A-Z]+"),
    prop("sample", "color", pvs=["Red ", "red", "Blue"]),
    prop("sample", "colors", "value-list", pvs=["Red", "Blue"]),
    prop("sample", "lost", cde_code="9", pvs=["own"]),
    prop("sample", "latest", cde_code="1"),
    prop("sample", "open", cde_code="2", cde_version="1", pvs=["closed"]),
]


@pytest.fixture(scope="module")
def ready(spark):
    nodes, props, _ = model(spark, NODES, PROPS)
    cde = local_table(
        spark,
        [{"code": "1", "version": "9.0", "pvs": ["new"]}, {"code": "1", "version": "10.0", "pvs": ["old"]},
         {"code": "2", "version": "1", "pvs": []}],
        "code STRING, version STRING, pvs ARRAY<STRING>",
    )
    synonyms = local_table(spark, [{"synonym": "Azure", "term": "Blue"}], "synonym STRING, term STRING")
    from tabgate.session import stage

    rules = stage(R.effective_rules(R.with_pattern_state(props), cde), "rules")
    return rules, stage(R.term_index(rules, synonyms), "terms"), stage(P.node_facts(nodes, props), "facts")


def cells(spark, ready, **props):
    rules, index, facts = ready
    return P.with_parsed(P.with_terms(
        P.cells(records(spark, record(props={"sample_id": "a", "kind": "x", **props})), rules, facts), index
    ))


def test_records_without_content_or_with_unknown_type(spark, ready):
    found = P.record_issues(
        records(
            spark, record("ok"), record("empty", props={}), record("typeless", node_type=None),
            record("none", props=None), record("odd", node_type="galaxy"), record("blank", props={"sample_id": " "}),
            record("nullkey", props={"sample_id": None}),
        ),
        ready[2],
    )
    assert rows(found, "record_id", "code") == [
        ("blank", "M022"), ("empty", "M021"), ("none", "M021"), ("odd", "M035"), ("typeless", "M021")]


def test_required_and_undefined(spark, ready):
    rules, _, facts = ready
    df = P.cells(
        records(
            spark, record("a", props={"sample_id": "a", "kind": None, "extra": "1"}),
            record("b", props={"sample_id": "b", "kind": " <DELETE>"}), record("c", node_type="bare", props={"x": "1"}),
        ), rules, facts)
    found = P.cell_issues(df, P.required_faults())
    assert rows(found, "record_id", "code", "offending_property") == [
        ("a", "M003", "kind"), ("a", "M017", "extra"), ("b", "M033", "kind"), ("c", "M026", "properties")]
    text = {r["code"]: r["description"] for r in found.collect()}
    assert text["M003"] == '[f.tsv: line 2] Required property "kind" is empty.'


CASES = [
    ("count", "1_000", []), ("count", "+7 ", []), ("count", "0", ["M011"]), ("count", "1.0", ["M004"]),
    ("count", "x", ["M004"]), ("ratio", "1e0", []), ("ratio", "2", ["M012"]), ("ratio", "nan", []),
    ("ratio", "inf", ["M012"]), ("ratio", "1,5", ["M005"]), ("ratio", ".5", []),
    ("day", "2024-02-29", []), ("day", "2/9/2024", []), ("day", "2023-02-29", ["M007"]), ("day", "", ["M007"]),
    ("flag", "YES", []), ("flag", "y", ["M008"]), ("code", "AB1", []), ("code", "1AB", ["M031"]),
    ("lost", "own", ["M027"]), ("lost", "x", ["M010", "M027"]), ("latest", "new", []), ("latest", "old", ["M010"]),
    ("open", "anything", []), ("color", "", ["M010"]), ("color", "<DELETE>", []),
]


def test_values(spark, ready):
    rules, index, facts = ready
    given = [
        record(str(n), props={"sample_id": str(n), "kind": "x", name: value}) for n, (name, value, _) in enumerate(CASES)
    ]
    df = P.with_parsed(P.with_terms(P.cells(records(spark, *given), rules, facts), index))
    found = rows(P.cell_issues(df, P.type_faults(), P.vocabulary_faults()), "record_id", "code")
    for n, (name, value, codes) in enumerate(CASES):
        assert sorted(code for ident, code in found if ident == str(n)) == codes, (name, value)


def test_zero_bounds_count_when_asked(spark, ready):
    df = cells(spark, ready, count="5")
    assert P.cell_issues(df, P.type_faults(ignore_zero_bounds=False)).first()["code"] == "M012"


def test_vocabulary_corrections_and_advice(spark, ready):
    rules, index, facts = ready
    names = local_table(spark, [{"submission_id": "s1", "study_name": "t", "program_name": "p"}],
                        "submission_id STRING, study_name STRING, program_name STRING")
    df = records(
        spark,
        record("a", props={"sample_id": " a", "color": "RED", "colors": "blue| RED", "flag": "No"}),
        record("b", props={"sample_id": "b", "color": "red", "colors": "blue|azure"}),
        record("c", props={"sample_id": "c", "color": "azure"}),
    )
    named = P.named_cells(P.cells(df, rules, facts), names, "program", "study")
    matched, lists = P.with_terms(named, index), P.list_terms(named, index)
    changed = P.corrections(matched, lists)
    assert rows(changed, "record_id", "prop", "new_value") == [
        ("a", "color", "Red"), ("a", "colors", "Blue|Red"), ("a", "flag", "false"), ("a", "sample_id", "a")]
    assert "It is recommended to use \"Blue\"" in P.cell_issues(matched, P.vocabulary_faults()).first()["description"]
    assert rows(P.list_issues(lists), "record_id", "offending_value") == [("b", "azure")]
    fixed = {r["record_id"]: r["props"] for r in P.corrected_records(df, changed).collect()}
    assert fixed["a"] == {"sample_id": "a", "color": "Red", "colors": "Blue|Red", "flag": "false"}
    assert fixed["b"]["colors"] == "blue|azure"


def test_duplicates_tell_their_number_and_members_stay_whole(spark, ready):
    facts = ready[2]
    many = [record(f"m{n}", node_id="hot", line_number=n) for n in range(30)]
    df = records(spark, record("x", line_number=7), record("y", line_number=9), *many)
    found = P.duplicate_issues(df, facts)
    assert found.count() == 32
    text = {r["record_id"]: r["description"] for r in found.collect()}
    assert text["x"].startswith("[f.tsv: line 7] Same ID also appears in 1 other rows of ")
    assert "29 other rows" in text["m3"]
    assert P.duplicate_members(df).filter("node_id = 'hot'").count() == 30


def test_names(spark, ready):
    nodes, props, _ = model(
        spark, [node("program", "pid", entity_type="Program"), node("study", "sid", entity_type="Study")],
        [prop("program", "pname", required=True), prop("study", "sname", required=True)])
    cde = local_table(spark, [], "code STRING, version STRING, pvs ARRAY<STRING>")
    rules = R.effective_rules(R.with_pattern_state(props), cde)
    subs = local_table(spark, [{"submission_id": s, "study_id": "t" + s} for s in "12"], "submission_id STRING, study_id STRING")
    studies = local_table(
        spark, [{"study_id": "t1", "study_name": "Big Study", "program_id": "p"},
                {"study_id": "t2", "study_name": "Other", "program_id": "gone"}],
        "study_id STRING, study_name STRING, program_id STRING")
    orgs = local_table(spark, [{"program_id": "p", "program_name": "Moon"}], "program_id STRING, program_name STRING")
    df = records(
        spark, record("a", submission_id="1", node_type="program", props={"pname": "MOON"}),
        record("b", submission_id="1", node_type="program", props={"pname": "Sun"}),
        record("c", submission_id="2", node_type="program", props={"pname": "Moon"}),
        record("d", submission_id="1", node_type="study", props={"sname": "big study"}),
        record("e", submission_id="1", node_type="study", props={"sname": "small"}))
    named = P.named_cells(P.cells(df, rules, P.node_facts(nodes, props)), P.submission_names(subs, studies, orgs), "pname", "sname")
    assert rows(P.cell_issues(named, P.name_faults()), "record_id", "code") == [("b", "M028"), ("c", "M030"), ("e", "M029")]
    assert rows(named.filter("value <> original"), "record_id", "value") == [("a", "Moon"), ("d", "Big Study")]
