from __future__ import annotations

from model import edge, model, node, prop, record, records, rel, rows

from tabgate.operators import delete as D
from tabgate.operators import relations as R
from tabgate.operators import release_checks as X
from tabgate.schema import RELEASES, local_table

NODES = [node("study", "study_id"), node("case", "case_id"), node("sample", "sample_id"), node("visit", "visit_id"),
         node("file", "file_id", is_file=True), node("group", "group_id")]
PROPS = [prop(k, f"{k}_id", required=True) for k in ("study", "case", "sample", "visit", "file", "group")]
RELS = [rel("case", "study"), rel("sample", "case"), rel("sample", "visit", "many_to_many"), rel("visit", "case", "one_to_one")]


def releases(spark, *rows_):
    base = {"release_id": "x", "submission_id": "old", "data_commons": "dc", "status": "Released", "node_type": "case",
            "node_id": "c1", "props": {}, "parents": []}
    return local_table(spark, [{**base, **r} for r in rows_], RELEASES)


def rec(kind, ident, *parents, **over):
    return record(over.pop("record_id", f"{kind}:{ident}"), node_type=kind, node_id=ident, id_prop=f"{kind}_id",
                  props={f"{kind}_id": ident}, parents=[edge(p, f"{p}_id", v) for p, v in parents], **over)


def test_edges(spark):
    nodes, props, rels = model(spark, NODES, PROPS, RELS)
    df = records(
        spark, rec("study", "s"), rec("case", "c1", ("study", "s")), rec("case", "c2"),
        rec("sample", "a", ("case", "c1"), ("case", "c9")), rec("sample", "b", ("moon", "m")),
        rec("sample", "c", ("study", "s")), rec("sample", "d", ("case", " ")), rec("sample", "e", ("case", "released")),
        record("odd", node_type="sample", node_id="o", parents=[edge("case", "color", "red")]))
    rel_rows = releases(spark, {"node_id": "released", "status": "Deleted"})
    judged = R.judged_edges(df, nodes, props, rels)
    assert rows(R.missing_parents(df, R.relation_rules(nodes, props, rels)[0]), "record_id") == [("case:c2",)]
    assert rows(R.edge_rule_issues(judged), "record_id", "broken") == [
        ("odd", "not a property of the parent"), ("sample:b", "unknown parent type"),
        ("sample:c", "relationship not defined"), ("sample:d", "blank parent id")]
    assert rows(R.several_parents(df, nodes, props, rels), "record_id", "code") == [("sample:a", "M025")]
    found = R.absent_parent_issues(R.sound_edges(judged), df, rel_rows)
    assert rows(found, "record_id", "parent_id_value") == [("sample:a", "c9")]


def test_one_to_one_counts_current_children_first_then_released(spark):
    nodes, props, rels = model(spark, NODES, PROPS, RELS)
    df = records(
        spark, *[rec("case", f"c{n}", ("study", "s")) for n in range(1, 4)],
        rec("visit", "v1", ("case", "c1")), rec("visit", "v2", ("case", "c1")), rec("visit", "v3", ("case", "c2")),
        rec("visit", "v4", ("case", "c3")))
    rel_rows = releases(
        spark, {"node_type": "visit", "node_id": "v9", "parents": [edge("case", "case_id", "c2")]},
        {"node_type": "visit", "node_id": "v4", "parents": [edge("case", "case_id", "c3")]})
    sound = R.sound_edges(R.judged_edges(df, nodes, props, rels))
    found = R.one_to_one_issues(sound, df, rel_rows, rels)
    assert rows(found, "record_id", "n_children") == [("visit:v1", 2), ("visit:v2", 2), ("visit:v3", 2)]
    assert "2 nodes" in found.filter("record_id = 'visit:v1'").first()["description"]
    members = R.one_to_one_children(df, rel_rows, rels)
    assert rows(members, "parent_id_value", "node_id") == [("c1", "v1"), ("c1", "v2"), ("c2", "v3"), ("c2", "v9")]


def test_consent_groups_are_sought_above_the_parents(spark):
    kinds = local_table(spark, [{"data_commons": "dc", "model_version": "1", "node_type": "file"}],
                        "data_commons STRING, model_version STRING, node_type STRING")
    df = records(
        spark, rec("file", "direct", ("group", "g1")), rec("file", "near", ("case", "c1")),
        rec("file", "far", ("sample", "p")), rec("file", "both", ("case", "c1"), ("case", "c2")),
        rec("sample", "p", ("case", "c2")), rec("case", "c1", ("group", "g1"), ("study", "s")), rec("study", "s", ("group", "g3")),
        rec("case", "loop", ("case", "loop")), rec("file", "round", ("case", "loop")))
    rel_rows = releases(
        spark, {"node_id": "c2", "parents": [edge("group", "group_id", "g2")]},
        {"node_type": "group", "node_id": "g1", "props": {"number": "-1"}, "parents": None},
        {"node_type": "group", "node_id": "g2", "props": {"number": "5"}, "parents": None})
    reach = R.consent_reach(df, rel_rows, kinds, "group")
    assert rows(reach, "record_id", "group_id") == [
        ("file:both", "g1"), ("file:both", "g2"), ("file:far", "g2"), ("file:near", "g1")]
    codes = R.consent_codes(reach, df, rel_rows, "group", "number")
    assert rows(codes, "record_id", "codes", "conflict") == [
        ("file:both", [], True), ("file:far", ["5"], False), ("file:near", ["-1"], False)]


def test_release_difference_and_pardon(spark):
    subs = local_table(
        spark, [{"submission_id": "s1", "intention": "New/Update"}, {"submission_id": "s2", "intention": "Delete"}],
        "submission_id STRING, intention STRING")
    nodes, props, _ = model(spark, NODES, PROPS, RELS)
    from tabgate.operators.properties import node_facts

    df = records(
        spark, rec("case", "same", ("study", "s")), rec("case", "moved", ("study", "t")),
        record("blank", node_type="case", node_id="blank", props={"case_id": ""}, parents=[]),
        record("more", node_type="case", node_id="more", props={"case_id": "more", "new": None}, parents=[]),
        rec("case", "gone", submission_id="s2"), rec("case", "same2", submission_id="s2"))
    one = [edge("study", "study_id", "s")]
    rel_rows = releases(
        spark, {"release_id": "1", "node_id": "same", "props": {"case_id": "same", "x": "1"}, "parents": one},
        {"release_id": "2", "node_id": "moved", "props": {"case_id": "moved"}, "parents": one},
        {"release_id": "3", "node_id": "blank", "props": {"case_id": "blank"}, "status": None},
        {"release_id": "4", "node_id": "more", "props": {"case_id": "more"}},
        {"release_id": "5", "node_id": "gone", "status": "Deleted"}, {"release_id": "6", "node_id": "same2"})
    found = X.release_issues(df, rel_rows, subs, node_facts(nodes, props))
    assert rows(found, "record_id", "code") == [("case:gone", "M019"), ("case:moved", "M018"), ("more", "M018")]


def test_cross_submissions(spark):
    subs = local_table(
        spark, [{"submission_id": s, "study_id": t, "status": v} for s, t, v in (
            ("s1", "t", "Submitted"), ("s2", "t", "Released"), ("s3", "t", "New"), ("s4", "u", "Submitted"))],
        "submission_id STRING, study_id STRING, status STRING")
    df = records(spark, *[record(f"{s}{i}", submission_id=s, node_id=i) for s in ("s1", "s2", "s3", "s4") for i in "ab" if s + i != "s2b"])
    found = X.cross_submission_issues(df, subs)
    assert rows(found, "record_id", "offending_value") == [("s1a", "1 submissions"), ("s2a", "1 submissions")]
    assert rows(X.cross_members(df, subs).filter("node_id = 'a'"), "study_id", "submission_id") == [
        ("t", "s1"), ("t", "s2"), ("u", "s4")]


def brute_cascade(rows_, start, by):
    deleted, parents = set(start), {r["record_id"]: list(r["parents"]) for r in rows_}
    level = set(start)
    kinds = {r["record_id"]: (r["node_type"], r["node_id"]) for r in rows_}
    while level:
        nodes = {kinds[r] for r in level}
        types = {k for k, _ in nodes}
        following = set()
        for r in rows_:
            ident = r["record_id"]
            if ident in deleted or not any((p["parent_type"], p["parent_id_value"]) in nodes for p in parents[ident]):
                continue
            if by == "type":
                parents[ident] = [p for p in parents[ident] if p["parent_type"] not in types]
            else:
                parents[ident] = [p for p in parents[ident] if (p["parent_type"], p["parent_id_value"]) not in nodes]
            if not parents[ident]:
                following.add(ident)
        deleted |= following
        level = following
    return sorted(deleted), parents


def test_cascade_against_brute_force(spark):
    import random

    pick = random.Random(5)
    rows_ = [rec("study", str(n)) for n in range(3)]
    for kind, above in (("case", ["study"]), ("visit", ["case"]), ("sample", ["case", "visit"]), ("file", ["sample", "case", "group"])):
        for n in range(25):
            links = {(k, str(pick.randrange(25 if k != "study" else 3))) for k in above for _ in range(pick.randrange(1, 3))}
            rows_.append(rec(kind, str(n), *sorted(links)))
    df = records(spark, *rows_)
    for by in ("type", "id"):
        start = df.filter("node_type = 'study' AND node_id = '1'")
        found = D.cascade(df, start, by=by)
        want, parents = brute_cascade(rows_, ["study:1"], by)
        assert [r[0] for r in rows(found.filter("action = 'deleted'"), "record_id")] == want
        left = {r["record_id"]: sorted(p["parent_id_value"] + p["parent_type"] for p in r["parents"])
                for r in found.filter("action = 'updated'").collect()}
        changed = {r["record_id"] for r in rows_ if r["record_id"] not in want and len(parents[r["record_id"]]) != len(r["parents"])}
        assert set(left) == changed
        assert all(left[i] == sorted(p["parent_id_value"] + p["parent_type"] for p in parents[i]) for i in changed)
