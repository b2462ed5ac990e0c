"""Relationship checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.functions.faults import ISSUE_KEYS, emit, fault, prefix
from tabgate.functions.text import is_blank
from tabgate.operators.frontier import walk
from tabgate.operators.lookup import attach, counted
from tabgate.operators.properties import PLACE
from tabgate.session import stage

EDGE = ("parent_type", "parent_id_prop", "parent_id_value")
MODEL = ("data_commons", "model_version")
OPEN_CODE = "-1"


def relation_rules(model_nodes: DataFrame, model_props: DataFrame, model_rels: DataFrame):
    """(per child type, per parent type and property, per child and parent type) lookup tables."""
    related = model_rels.groupBy(*MODEL, "node_type").agg(F.lit(True).alias("has_rels"))
    parents = model_nodes.select(*MODEL, F.col("node_type").alias("parent_type"), F.lit(True).alias("known_parent"))
    props = model_props.select(
        *MODEL, F.col("node_type").alias("parent_type"), F.col("prop").alias("parent_id_prop"),
        F.lit(True).alias("known_prop"),
    )
    rels = model_rels.select(*MODEL, "node_type", "parent_type", "multiplicity")
    return related, parents, props, rels


def missing_parents(records: DataFrame, related: DataFrame, keep=(*ISSUE_KEYS, "data_commons")) -> DataFrame:
    """E1 (M013): a type with relationships, a record without parents."""
    bare = records.filter(F.coalesce(F.size("parents"), F.lit(0)) <= 0)
    rows = bare.join(related, [*MODEL, "node_type"], "left_semi")
    return emit(rows, [fault("M013", F.lit(True), F.col("node_type"), F.col("node_id"), prefix())], keep)


def edges(records: DataFrame) -> DataFrame:
    return records.select(*PLACE, F.posexplode("parents").alias("pos", "edge")).select(
        *PLACE, "pos", *[F.col(f"edge.{e}").alias(e) for e in EDGE]
    )


def judged_edges(records: DataFrame, model_nodes, model_props, model_rels) -> DataFrame:
    """Edges of types that have relationships, with the first rule each one breaks (null: none)."""
    related, parents, props, rels = relation_rules(model_nodes, model_props, model_rels)
    rows = edges(records).join(related, [*MODEL, "node_type"], "left_semi")
    rows = (
        rows.join(parents, [*MODEL, "parent_type"], "left")
        .join(props, [*MODEL, "parent_type", "parent_id_prop"], "left")
        .join(rels, [*MODEL, "node_type", "parent_type"], "left")
    )
    return rows.withColumn(
        "broken",
        F.when(F.col("known_parent").isNull(), "unknown parent type")
        .when(F.col("known_prop").isNull(), "not a property of the parent")
        .when(F.col("multiplicity").isNull(), "relationship not defined")
        .when(is_blank(F.col("parent_id_value")), "blank parent id"),
    )


def edge_rule_issues(judged: DataFrame) -> DataFrame:
    """E2 (M023)."""
    of = F.format_string("“%s” of “%s”", F.col("parent_id_prop"), F.col("parent_type"))
    of_plain = F.format_string('"%s" of "%s"', F.col("parent_id_prop"), F.col("parent_type"))
    shown = (
        F.when(F.col("broken") == "not a property of the parent", of_plain)
        .when(F.col("broken") == "blank parent id", of)
        .otherwise(F.col("parent_type"))
    )
    return emit(
        judged,
        [fault("M023", F.col("broken").isNotNull(), F.col("node_type"), F.col("node_id"), prefix(), shown)],
        keep=(*ISSUE_KEYS, "pos", "broken"),
    )


def several_parents(records: DataFrame, model_nodes, model_props, model_rels) -> DataFrame:
    """E3 (M024, M025): several parents of one type and id property where only one is allowed.

    A record carries its parents, so the grouping happens inside the row, without a shuffle. The
    group is reported when at least one of its edges keeps the rules of E2.
    """
    related, _, props, rels = relation_rules(model_nodes, model_props, model_rels)
    kinds = F.array_distinct(
        F.transform("parents", lambda p: F.struct(p["parent_type"].alias("parent_type"),
                                                  p["parent_id_prop"].alias("parent_id_prop")))
    )
    # Parents that are all of different types, as those of most records are, need no look at each kind.
    types = F.array_distinct(F.col("parents.parent_type"))
    rows = records.filter((F.size("parents") > 1) & (F.size(types) < F.size("parents"))).select(
        *PLACE, "parents", F.inline(kinds))
    same = F.filter(
        "parents",
        lambda p: (p["parent_type"] == F.col("parent_type")) & (p["parent_id_prop"] == F.col("parent_id_prop")),
    )
    rows = rows.withColumn("ids", F.transform(same, lambda p: p["parent_id_value"])).filter(
        (F.size("ids") > 1) & F.exists("ids", lambda i: ~is_blank(i))
    )
    rows = (
        rows.join(related, [*MODEL, "node_type"], "left_semi")
        .join(props, [*MODEL, "parent_type", "parent_id_prop"], "left_semi")
        .join(rels, [*MODEL, "node_type", "parent_type"])
        .filter(F.col("multiplicity") != "many_to_many")
    )
    shown = F.to_json("ids")
    one = F.col("multiplicity") == "one_to_one"
    place = (F.col("node_type"), F.col("node_id"), prefix(), F.col("parent_type"), shown)
    return emit(
        rows, [fault("M024", one, *place), fault("M025", ~one, *place)], keep=(*ISSUE_KEYS, "parent_type", "ids")
    )


# --- E4 ----------------------------------------------------------------------------------------

PARENT_KEY = ["submission_id", "data_commons", *EDGE]


def parent_keys(sound: DataFrame) -> DataFrame:
    """Distinct parents looked for, with the number of edges; copies collapse before the shuffle."""
    return counted(sound, PARENT_KEY, name="n_edges")


def present_parents(keys: DataFrame, records: DataFrame, releases: DataFrame) -> DataFrame:
    """Parent keys found in the submission (with that property carrying the id) or in any release.

    The keys are stored, being read twice. Only nodes of types that are looked for are asked which property carries their id:
    most records are of types that are nobody's parent.
    """
    keys = stage(keys, "parent-keys")
    kinds = stage(keys.select("parent_type").distinct(), "parent-types").withColumnRenamed("parent_type", "node_type")
    records, releases = (rows.join(kinds, "node_type", "left_semi") for rows in (records, releases))
    holders = records.select(
        "submission_id", F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id_value"),
        F.explode(F.map_keys(F.map_filter("props", lambda k, v: v == F.col("node_id")))).alias("parent_id_prop"),
    ).distinct()
    released = releases.select(
        "data_commons", F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id_value")
    ).distinct()
    here = keys.join(
        holders.withColumn("here", F.lit(True)), ["submission_id", *EDGE], "left"
    )
    return here.join(
        released.withColumn("before", F.lit(True)), ["data_commons", "parent_type", "parent_id_value"], "left"
    ).select(*keys.columns, F.coalesce("here", "before", F.lit(False)).alias("present"))


def sound_edges(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("broken").isNull())


def absent_parent_issues(sound: DataFrame, records: DataFrame, releases: DataFrame) -> DataFrame:
    """E4 (M014): keys are checked once each, then the verdict goes back to the edges."""
    absent = present_parents(parent_keys(sound), records, releases).filter(~F.col("present"))
    hit = attach(sound, absent, PARENT_KEY, "n_edges", spread_by=["record_id", "pos"]).filter(
        F.col("present").isNotNull()
    )
    what = F.format_string('[“%s”: “%s"]', F.col("parent_id_prop"), F.col("parent_id_value"))
    return emit(
        hit,
        [fault("M014", F.lit(True), F.col("node_type"), F.col("node_id"), prefix(), F.col("parent_type"), what)],
        keep=(*ISSUE_KEYS, "pos", "parent_type", "parent_id_value"),
    )


# --- E5 ----------------------------------------------------------------------------------------

CHILD_KEY = ["submission_id", "data_commons", *EDGE, "node_type"]
RELEASED_CHILD_KEY = ["data_commons", *EDGE, "node_type"]


def children(records: DataFrame) -> DataFrame:
    """Distinct current children of every parent key; the complete group, one row per child."""
    return counted(edges(records), [*CHILD_KEY, "node_id"], name="n_edges")


def released_children(releases: DataFrame) -> DataFrame:
    long = releases.select("data_commons", "node_type", "node_id", F.explode("parents").alias("edge"))
    return long.select(
        "data_commons", *[F.col(f"edge.{e}").alias(e) for e in EDGE], "node_type", "node_id"
    ).distinct()


def child_counts(current: DataFrame, released: DataFrame) -> DataFrame:
    """Per parent key: its children now, and those of the releases when at most one is current.

    Only counts and one membership flag meet; no child list is built or crossed with another.
    """
    now = current.groupBy(*CHILD_KEY).agg(
        F.count(F.lit(1)).alias("n_now"), F.min("node_id").alias("node_id"), F.sum("n_edges").alias("n_edges")
    )
    before = released.groupBy(*RELEASED_CHILD_KEY).agg(F.count(F.lit(1)).alias("n_before"))
    joined = now.join(before, RELEASED_CHILD_KEY, "left").join(
        released.withColumn("only_child_released", F.lit(True)), [*RELEASED_CHILD_KEY, "node_id"], "left"
    )
    total = F.col("n_now") + F.coalesce("n_before", F.lit(0)) - F.when(F.col("only_child_released"), 1).otherwise(0)
    return joined.select(
        *CHILD_KEY, "n_now", "n_edges", F.when(F.col("n_now") > 1, F.col("n_now")).otherwise(total).alias("n_children")
    )


def one_to_one_issues(
    sound: DataFrame, records: DataFrame, releases: DataFrame, model_rels: DataFrame
) -> DataFrame:
    """E5 (M024): a parent that exists and has more than one child of this type.

    The text tells how many there are; ``one_to_one_children`` has them all, one row each.
    """
    crowded, _, _ = crowded_parents(records, releases, model_rels)
    single = sound.filter(F.col("multiplicity") == "one_to_one")
    hit = attach(single, crowded.drop("n_now"), CHILD_KEY, "n_edges", spread_by=["record_id", "pos"]).filter(
        F.col("n_children").isNotNull()
    )
    text = F.format_string(
        '"%s": associated node “%s”: “%s" has multiple nodes associated: %s.', prefix(), F.col("parent_type"),
        F.col("parent_id_value"), F.format_string("%s nodes", F.col("n_children")),
    )
    return emit(
        hit, [fault("M024", F.lit(True), F.col("node_type"), F.col("node_id"), description=text)],
        keep=(*ISSUE_KEYS, "pos", "parent_type", "parent_id_value", "n_children"),
    )


def crowded_parents(
    records: DataFrame, releases: DataFrame, model_rels: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents with more than one child where the model allows one, children now, released children)."""
    single_kinds = model_rels.filter(F.col("multiplicity") == "one_to_one").select(
        "data_commons", "node_type", "parent_type"
    ).distinct()
    on = ["data_commons", "node_type", "parent_type"]
    current = children(records).join(single_kinds, on, "left_semi")
    released = released_children(releases).join(single_kinds, on, "left_semi")
    full = child_counts(current, released).filter(F.col("n_children") > 1)
    crowded = stage(present_parents(full, records, releases).filter(F.col("present")).drop("present"), "crowded")
    return crowded, current, released


def one_to_one_children(records: DataFrame, releases: DataFrame, model_rels: DataFrame) -> DataFrame:
    """E5: every child of a crowded parent, one row each."""
    crowded, current, released = crowded_parents(records, releases, model_rels)
    before = crowded.filter(F.col("n_now") <= 1).select(*CHILD_KEY).join(released, RELEASED_CHILD_KEY)
    ids = [*CHILD_KEY, "node_id"]
    now = current.select(*ids).join(crowded.select(*CHILD_KEY), CHILD_KEY, "left_semi")
    return now.unionByName(before.select(*ids)).distinct()


# --- E6, E7 ------------------------------------------------------------------------------------

NODE = ["submission_id", "data_commons", "parent_type", "parent_id_value"]


def parent_links(records: DataFrame, releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct links from a node to a parent in current records and in releases, stored for all rounds of a walk.

    A walk only comes to nodes that are somebody's parent, so nodes of types that no link leads to, such as files, are left
    out; they are most of the records.
    """
    kinds = [rows.select(F.array_distinct("parents.parent_type").alias("types")).distinct().select(F.explode("types").alias("node_type"))
             for rows in (records, releases)]
    led_to = stage(kinds[0].unionByName(kinds[1]).distinct(), "parent-types")
    records, releases = (rows.join(led_to, "node_type", "left_semi") for rows in (records, releases))
    here = records.filter(F.size("parents") > 0).select(
        "submission_id", F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id_value"),
        F.explode("parents").alias("up"),
    ).distinct()
    before = releases.filter(F.size("parents") > 0).select(
        "data_commons", F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id_value"),
        F.explode("parents").alias("up"),
    ).distinct()
    return stage(here, "links"), stage(before, "released-links")


def upward_links(links: tuple[DataFrame, DataFrame], start: DataFrame) -> DataFrame:
    """One step up for distinct nodes: the parents of the current record, else of the release."""
    here, before = links
    on = ["submission_id", "parent_type", "parent_id_value"]
    now = start.join(here, on).select(*NODE, "up")
    rest = start.join(here, on, "left_anti").join(before, ["data_commons", "parent_type", "parent_id_value"])
    return now.unionByName(rest.select(*NODE, "up"))


def climbed_links(
    records: DataFrame, releases: DataFrame, file_types: DataFrame, consent_type: str, among: DataFrame | None = None
):
    """The parent links of file records, their number by parent, stored, and all links met on the way up to consent groups,
    through the records ``among``.

    The walk runs over distinct nodes, not over records: every node on the way is asked once for
    its consent groups, whatever number of files hang below it. A node whose parents include
    consent groups stops the climb there.
    """
    files = records.join(file_types, [*MODEL, "node_type"], "left_semi")
    file_edges = files.select(
        "submission_id", "data_commons", "record_id", F.explode("parents").alias("edge")
    ).select(
        "submission_id", "data_commons", "record_id", F.col("edge.parent_type").alias("parent_type"),
        F.col("edge.parent_id_value").alias("parent_id_value"),
    )
    stored = parent_links(records if among is None else among, releases)
    # Nodes of types without any parent, that many files may name, lead nowhere.
    asked = stage(stored[0].select("parent_type").union(stored[1].select("parent_type")).distinct(), "linked-types")
    file_edges = file_edges.join(asked, "parent_type", "left_semi")
    start = stage(counted(file_edges, NODE, name="n_edges"), "file-parents")

    def climb(level: DataFrame) -> DataFrame:
        links = upward_links(stored, level)
        stops = links.groupBy(*NODE).agg(F.max(F.col("up.parent_type") == consent_type).alias("stops"))
        go = links.join(stops.filter(~F.col("stops")), NODE, "left_semi")
        return go.select(
            "submission_id", "data_commons", F.col("up.parent_type").alias("parent_type"),
            F.col("up.parent_id_value").alias("parent_id_value"),
        )

    nodes = walk(start.select(*NODE), climb, NODE)
    return file_edges, start, upward_links(stored, nodes)


def seen_groups(records, releases, file_types, consent_type: str, among: DataFrame | None = None):
    """The parent links of file records, their number by parent, and the consent groups seen from each node."""
    file_edges, weights, links = climbed_links(records, releases, file_types, consent_type, among)
    flat = stage(links.select(
        *NODE, F.col("up.parent_type").alias("up_type"), F.col("up.parent_id_value").alias("up_id")
    ).distinct(), "climbed-links")
    stops = flat.groupBy(*NODE).agg(F.max(F.col("up_type") == consent_type).alias("stops"))
    # Groups seen from each node: its own, or those its parents see; bottom-up over distinct nodes.
    reach = flat.filter(F.col("up_type") == consent_type).select(*NODE, F.col("up_id").alias("group_id")).distinct()
    passing = flat.join(stops.filter(~F.col("stops")), NODE, "left_semi").select(
        "submission_id", "data_commons", F.col("parent_type").alias("low_type"),
        F.col("parent_id_value").alias("low_id"), F.col("up_type").alias("parent_type"),
        F.col("up_id").alias("parent_id_value"),
    )

    def down(level: DataFrame) -> DataFrame:
        return level.join(passing, NODE).select(
            "submission_id", "data_commons", F.col("low_type").alias("parent_type"),
            F.col("low_id").alias("parent_id_value"), "group_id",
        )

    return file_edges, weights, walk(reach, down, [*NODE, "group_id"])


def met_groups(file_edges: DataFrame, weights: DataFrame, seen: DataFrame, what: Column) -> DataFrame:
    """The file edges whose parent sees consent groups, with these as ``groups``. They are gathered per node (a node sees few)
    so that each file edge meets one row per node."""
    facts = seen.groupBy(*NODE).agg(F.collect_set(what).alias("groups")).join(weights, NODE)
    return attach(file_edges, facts, NODE, "n_edges", spread_by=["record_id"]).filter(F.col("groups").isNotNull())


def consent_reach(records, releases, file_types, consent_type: str, among: DataFrame | None = None) -> DataFrame:
    """Distinct (submission, record, consent group id)."""
    met = met_groups(*seen_groups(records, releases, file_types, consent_type, among), F.col("group_id"))
    return met.select("submission_id", "data_commons", "record_id", F.explode("groups").alias("group_id")).distinct()


GROUP = ["submission_id", "data_commons", "group_id"]


def group_codes(groups: DataFrame, records: DataFrame, releases: DataFrame, consent_type: str, number_prop: str) -> DataFrame:
    """The code of each group: that of the current record, else of the release."""
    here = records.filter(F.col("node_type") == consent_type).groupBy(
        "submission_id", F.col("node_id").alias("group_id")
    ).agg(F.min(F.struct("record_id", F.try_element_at("props", F.lit(number_prop)).alias("code"))).alias("here"))
    before = releases.filter(F.col("node_type") == consent_type).groupBy(
        "data_commons", F.col("node_id").alias("group_id")
    ).agg(F.min(F.struct("release_id", F.try_element_at("props", F.lit(number_prop)).alias("code"))).alias("before"))
    return (
        groups.join(here, ["submission_id", "group_id"], "left")
        .join(before, ["data_commons", "group_id"], "left")
        .select(*GROUP, F.when(F.col("here").isNotNull(), F.col("here.code")).otherwise(F.col("before.code")).alias("code"))
    )


def with_codes(rows: DataFrame, records, releases, consent_type: str, number_prop: str, spread_by: list[str]) -> DataFrame:
    """Rows with a group, and its code. A group may have most of the rows."""
    weights = stage(counted(rows, GROUP), "groups")
    coded = group_codes(weights.select(*GROUP), records, releases, consent_type, number_prop)
    return attach(rows, coded.join(weights, GROUP), GROUP, "n_rows", spread_by=spread_by).drop("n_rows")


def conflicts(per_record: DataFrame) -> DataFrame:
    """``per_record``: submission_id, record_id, codes."""
    mixed = (
        (F.size("codes") > 1) & F.array_contains("codes", OPEN_CODE)
        & F.exists("codes", lambda c: c != OPEN_CODE)
    )
    return per_record.select(
        "submission_id", "record_id", mixed.alias("conflict"),
        F.when(mixed, F.array().cast("array<string>")).otherwise(F.col("codes")).alias("codes"),
    )


def consent_codes(
    reach: DataFrame, records: DataFrame, releases: DataFrame, consent_type: str, number_prop: str
) -> DataFrame:
    """(record, codes, conflict) of the groups that ``reach`` tells: current record first, else release."""
    reach = stage(reach, "reach")
    joined = with_codes(reach, records, releases, consent_type, number_prop, ["record_id"])
    # One group per record: the consent groups one file belongs to.
    return conflicts(joined.groupBy("submission_id", "record_id").agg(
        F.array_sort(F.collect_list(F.nullif(F.col("code"), F.lit("")))).alias("codes")
    ))


def file_consent_codes(
    records, releases, file_types, consent_type: str, number_prop: str, among: DataFrame | None = None
) -> DataFrame:
    """E6, E7 in one: consent_codes of all that consent_reach finds. Codes join the nodes that see the groups, which are fewer
    than the records below them, so what a record reaches is gathered once and needn't be stored."""
    file_edges, weights, seen = seen_groups(records, releases, file_types, consent_type, among)
    coded = with_codes(
        seen, records if among is None else among, releases, consent_type, number_prop, ["parent_type", "parent_id_value"])
    met = met_groups(file_edges, weights, coded, F.struct("data_commons", "group_id", "code"))
    # A group that a record reaches through several parents is one.
    reached = F.array_distinct(F.flatten(F.collect_set("groups")))
    per_record = met.groupBy("submission_id", "record_id").agg(reached.alias("reached"))
    codes = F.transform("reached", lambda g: F.nullif(g["code"], F.lit("")))
    return conflicts(per_record.select(
        "submission_id", "record_id", F.array_sort(F.array_compact(codes)).alias("codes")))


def consent_issues(records: DataFrame, coded: DataFrame) -> DataFrame:
    rows = records.join(coded.filter("conflict"), ["submission_id", "record_id"])
    return emit(rows, [fault("M036", F.lit(True), F.col("node_type"), F.col("node_id"), prefix())])


def relation_issue_parts(records, releases, model_nodes, model_props, model_rels, among=None) -> list[DataFrame]:
    """E1-E5, one DataFrame per check. Parents and siblings are looked for ``among`` all records, by default the same."""
    among = records if among is None else among
    judged = judged_edges(records, model_nodes, model_props, model_rels)
    sound = sound_edges(judged)
    related = relation_rules(model_nodes, model_props, model_rels)[0]
    return [
        missing_parents(records, related),
        edge_rule_issues(judged),
        several_parents(records, model_nodes, model_props, model_rels),
        absent_parent_issues(sound, among, releases),
        one_to_one_issues(sound, among, releases, model_rels),
    ]
