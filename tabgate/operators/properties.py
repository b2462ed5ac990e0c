"""Property checks. Properties are exploded once; each check is an expression on the exploded row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.functions import typed
from tabgate.functions.faults import ISSUE_KEYS, emit, fault, prefix, selected
from tabgate.functions.text import DELETE_MARK, is_blank, split_plain, strip
from tabgate.messages import ERROR, PASSED, WARNING
from tabgate.operators.lookup import SPREAD, attach, counted
from tabgate.operators.rules import KNOWN_TYPES, anchored_pattern
from tabgate.session import stage

RULE_ON = ("data_commons", "model_version", "node_type", "prop")
PLACE = (*ISSUE_KEYS, "file_name", "line_number", "data_commons", "model_version")
LIST_TYPES = ("array", "value-list")
DUPLICATE_KEY = ["submission_id", "node_type", "node_id"]


def node_facts(model_nodes: DataFrame, model_props: DataFrame) -> DataFrame:
    """Model nodes and whether they define any property."""
    defined = model_props.groupBy("data_commons", "model_version", "node_type").agg(F.lit(True).alias("has_props"))
    return model_nodes.join(defined, ["data_commons", "model_version", "node_type"], "left").select(
        "data_commons", "model_version", "node_type", F.col("id_prop").alias("model_id_prop"),
        F.col("entity_type").alias("model_entity"), "is_file", "name_field",
        F.coalesce("has_props", F.lit(False)).alias("has_props"), F.lit(True).alias("known_node"),
    )


def on_nodes(records: DataFrame, facts: DataFrame) -> DataFrame:
    return records.join(facts, ["data_commons", "model_version", "node_type"], "left")


def empty_record() -> Column:
    return F.col("node_type").isNull() | F.col("props").isNull() | (F.size("props") == 0)


def record_issues(records: DataFrame, facts: DataFrame, codes=None) -> DataFrame:
    """Records without type or content, unknown types, blank keys (M021, M035, M022)."""
    rows = on_nodes(records, facts)
    key = F.try_element_at("props", F.col("model_id_prop"))
    faults = {
        "M021": fault("M021", empty_record(), "NodeType", "", prefix()),
        "M035": fault("M035", ~empty_record() & F.col("known_node").isNull(), "NodeType", "", prefix(),
                      F.col("node_type")),
        "M022": fault("M022", ~empty_record() & (strip(key) == ""), F.col("model_id_prop"), "", prefix(),
                      F.col("model_id_prop")),
    }
    return emit(rows, selected(faults, codes))


# --- D3 ----------------------------------------------------------------------------------------


def duplicate_members(records: DataFrame) -> DataFrame:
    """All rows of every id stored more than once: the complete group, one row per member."""
    groups = counted(records, DUPLICATE_KEY, at_least=2, name="n_copies")
    marked = attach(
        records.select(*DUPLICATE_KEY, "record_id", "file_name", "line_number"),
        groups, DUPLICATE_KEY, "n_copies", spread_by=["record_id"],
    )
    return marked.filter(F.col("n_copies").isNotNull())


def duplicate_issues(records: DataFrame, facts: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """D3 (M016). The text tells how many other rows there are ``among`` all records, by default the same;
    duplicate_members has them all, one row each."""
    rows = on_nodes(records, facts)
    key = F.try_element_at("props", F.col("model_id_prop"))
    checked = rows.filter(
        ~empty_record() & F.col("known_node").isNotNull() & F.coalesce(strip(key) != "", F.lit(True))
    )
    groups = counted(records if among is None else among, DUPLICATE_KEY, at_least=2, name="n_copies")
    hit = attach(
        checked.select(*PLACE, F.col("model_id_prop"), key.alias("key_value")),
        groups, DUPLICATE_KEY, "n_copies", spread_by=["record_id"],
    ).filter(F.col("n_copies").isNotNull())
    others = F.format_string("%s other rows of %s %s", F.col("n_copies") - 1, F.col("node_type"), F.col("node_id"))
    return emit(
        hit,
        [fault("M016", F.lit(True), F.col("model_id_prop"), F.col("key_value"), prefix(), others)],
        keep=(*ISSUE_KEYS, "n_copies"),
    )


# --- cells -------------------------------------------------------------------------------------


def cells(records: DataFrame, rules: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per property of every usable record, with its rule (null rule: not in the model)."""
    rows = on_nodes(records, facts).filter(~empty_record() & F.col("known_node").isNotNull())
    long = rows.select(
        *PLACE, "model_entity", "has_props", F.explode("props").alias("prop", "value")
    ).withColumn("original", F.col("value"))
    # The lists themselves are in the term index; no cell carries them.
    marked = rules.drop("pvs").withColumn("has_rule", F.lit(True))
    return long.join(marked, list(RULE_ON), "left")


def required_faults() -> dict[str, Column]:
    """Undefined properties, empty required ones, deletion of required ones."""
    prop, value = F.col("prop"), F.col("original")
    blank = is_blank(value)
    needed = F.col("has_rule") & F.coalesce("required", F.lit(False))
    deleted = F.lower(strip(value)) == DELETE_MARK
    return {
        "M026": fault("M026", ~F.col("has_props"), "properties", ""),
        "M017": fault("M017", F.col("has_props") & F.col("has_rule").isNull(), prop, value, prefix(), prop),
        "M003": fault("M003", needed & blank, prop, value, prefix(), prop),
        "M033": fault("M033", needed & ~blank & deleted, prop, value, prefix(), prop),
    }


def cell_issues(rows: DataFrame, *families: dict[str, Column], codes=None, keep=ISSUE_KEYS) -> DataFrame:
    """Issues of any number of check families in one pass over the cells."""
    faults = [fault for family in families for fault in selected(family, codes)]
    return emit(rows, faults, keep)


def file_name_issues(records: DataFrame, facts: DataFrame, keep=ISSUE_KEYS) -> DataFrame:
    """With Delete intention only the file name of file nodes is required."""
    rows = on_nodes(records, facts).filter(F.col("is_file") & F.col("name_field").isNotNull())
    value = F.try_element_at("props", F.col("name_field"))
    return emit(
        rows,
        [fault("M003", is_blank(value), F.col("name_field"), strip(F.coalesce(value, F.lit(""))), prefix(),
               F.col("name_field"))],
        keep,
    )


# --- D7 ----------------------------------------------------------------------------------------


def submission_names(submissions: DataFrame, studies: DataFrame, organizations: DataFrame) -> DataFrame:
    return (
        submissions.select("submission_id", "study_id")
        .join(studies.select("study_id", "study_name", "program_id"), "study_id", "left")
        .join(organizations.select("program_id", "program_name"), "program_id", "left")
        .select("submission_id", "study_name", "program_name")
    )


def named_cells(cells: DataFrame, names: DataFrame, program_prop: str, study_prop: str) -> DataFrame:
    """Adds what a required Program or Study name must be equal to, and puts the registered spelling
    into ``value`` where only the case differs. Only cells that may be such a name meet the names."""
    about = F.when(
        (F.col("prop") == program_prop) & (F.col("model_entity") == "Program"), F.lit("program")
    ).when((F.col("prop") == study_prop) & (F.col("model_entity") == "Study"), F.lit("study"))
    bare = F.col("_bare")
    filled = F.coalesce("required", F.lit(False)) & (bare != "") & (F.lower(bare) != DELETE_MARK)
    rest = cells.filter(about.isNull())
    # By their type first: records that can't have such a name are not made into cells for it.
    entitled = cells.filter(F.col("model_entity").isin("Program", "Study"))
    joined = entitled.filter(about.isNotNull()).withColumn("_bare", strip(F.col("original"))).join(
        names, "submission_id", "left"
    ).withColumn("names_what", F.when(filled, about)).drop("_bare")
    due = F.when(F.col("names_what") == "program", F.col("program_name")).when(
        F.col("names_what") == "study", F.col("study_name"))
    spelled = joined.withColumn("_due", due).withColumn(
        "value", F.when(_same(F.col("_due"), F.col("original")), F.col("_due")).otherwise(F.col("original"))
    ).drop("_due")
    return rest.withColumn("value", F.col("original")).unionByName(spelled, allowMissingColumns=True)


def _same(left: Column, right: Column) -> Column:
    return F.coalesce(F.lower(left) == F.lower(right), F.lit(False))


def name_faults() -> dict[str, Column]:
    """M030 no program, M028 other program, M029 other study."""
    prop, value, program, study = F.col("prop"), F.col("original"), F.col("program_name"), F.col("study_name")
    about_program = F.col("names_what") == "program"
    advice = F.concat(
        F.lit("Program name doesn't match this study's associated programs - '"), program, F.lit("'")
    )
    return {
        "M030": fault("M030", about_program & program.isNull(), prop, value, prefix(), study),
        "M028": fault("M028", about_program & program.isNotNull() & ~_same(program, value), prop, value, prefix(),
                      advice),
        "M029": fault("M029", (F.col("names_what") == "study") & ~_same(study, value), prop, value, prefix(), study),
    }


# --- D8, D9, D13-D17: checks that need nothing but the cell and its rule -------------------------


def has_value() -> Column:
    """Cells the value checks look at: a rule and a value."""
    return F.coalesce("has_rule", F.lit(False)) & F.col("value").isNotNull()


def with_parsed(cells: DataFrame) -> DataFrame:
    """Adds the stripped text of the value and the numeric reading of integer and number cells, worked out once for all
    checks that use them."""
    kind, text = F.col("type"), F.col("text")
    return cells.withColumn("text", F.when(has_value(), strip(F.col("value")))).withColumns(
        {
            "whole": F.when(kind == "integer", text.rlike(typed.INTEGER_SHAPE)),
            "number": F.when(kind.isin("integer", "number"), typed.number_in(text)),
        }
    )


def type_faults(layouts=typed.DATE_LAYOUTS, ignore_zero_bounds: bool = True) -> dict[str, Column]:
    """D8, D9, D13-D17 and the missing elements of D10, on cells that went through with_parsed."""
    prop, value, kind, filled = F.col("prop"), F.col("value"), F.col("type"), has_value()
    anchored = anchored_pattern(F.col("pattern"))
    usable = F.coalesce(F.col("pattern") != "", F.lit(False)) & F.coalesce("pattern_ok", F.lit(False))
    is_pattern = filled & (kind == "pattern")
    fits = F.when(usable, F.rlike(value, anchored)).otherwise(F.lit(True))
    number, whole = F.col("number"), F.col("whole")
    shown = F.when(kind == "integer", typed.integer_text(value)).otherwise(strip(value))
    bounded = number.isNotNull() & F.coalesce(whole, F.lit(True))
    low, high = _bound("min", ignore_zero_bounds), _bound("max", ignore_zero_bounds)
    under = F.when(F.col("min_exclusive"), _below(number, low, True)).otherwise(_below(number, low, False))
    over = F.when(F.col("max_exclusive"), _below(high, number, True)).otherwise(_below(high, number, False))
    known = kind.isin(*KNOWN_TYPES)
    odd_date = kind.isin("date", "datetime") & typed.as_moment(value, layouts).isNull()
    return {
        "M009": fault("M009", filled & (kind.isNull() | ~known), prop, value, prefix(), prop, kind),
        "M031": fault("M031", is_pattern & ~fits, prop, value, prefix(), value, prop),
        "M032": fault("M032", is_pattern & ~usable, prop, F.col("pattern"), prefix(), F.col("pattern"), prop),
        "M027": fault("M027", filled & known & (kind != "pattern") & F.col("cde_missing"), prop, value, prefix(), prop),
        "M004": fault("M004", ~whole, prop, value, prefix(), prop, value),
        "M005": fault("M005", filled & (kind == "number") & number.isNull(), prop, value, prefix(), prop, value),
        "M011": fault("M011", bounded & under, prop, shown, prefix(), prop, shown),
        "M012": fault("M012", bounded & over, prop, shown, prefix(), prop, shown),
        "M007": fault("M007", filled & odd_date, prop, value, prefix(), prop, value),
        "M008": fault("M008", filled & (kind == "boolean") & typed.as_flag(value).isNull(), prop, value, prefix(),
                      prop, value),
    }


def _bound(name: str, ignore_zero: bool) -> Column:
    return F.when(F.col(name) != 0, F.col(name)) if ignore_zero else F.col(name)


def _below(left: Column, right: Column, or_equal: bool) -> Column:
    # Spark orders NaN above all numbers; the comparison here must be false for NaN on either side.
    real = ~F.isnan(left) & ~F.isnan(right)
    return F.coalesce(real & ((left <= right) if or_equal else (left < right)), F.lit(False))


# --- D11, D12, D18: vocabulary -----------------------------------------------------------------


def with_terms(cells: DataFrame, index: DataFrame) -> DataFrame:
    """Adds the vocabulary match of string, integer and number cells.

    ``looked_up`` says that the cell has a vocabulary and a text to look up; ``entry`` is then null
    for a value outside the vocabulary. Cells without a vocabulary have no key; should the index be
    too large to broadcast, a salt spreads them over the shuffle.
    """
    kind, text = F.col("type"), F.col("text")
    cells = cells if "number" in cells.columns else with_parsed(cells)  # numbers are read once, for this and the checks
    shown = F.when(
        F.col("vocab_id").isNotNull(),
        F.when(kind == "string", text)
        .when(kind == "integer", typed.integer_in(text))
        .when(kind == "number", typed.number_text(F.col("number"))),
    )
    rows = cells.withColumn("shown", shown).withColumn("_key", F.lower("shown"))
    rows = rows.withColumn(
        "_salt", F.when(F.col("_key").isNull(), 1 + F.pmod(F.xxhash64("record_id", "prop"), F.lit(SPREAD))).otherwise(0)
    )
    terms = index.withColumnsRenamed({"vocab_id": "_vocab", "term": "_term"}).withColumn("_zero", F.lit(0))
    joined = rows.join(
        terms,
        (F.col("vocab_id") == F.col("_vocab")) & (F.col("_key") == F.col("_term")) & (F.col("_salt") == F.col("_zero")),
        "left",
    )
    return joined.drop("_key", "_salt", "_vocab", "_term", "_zero").withColumn(
        "looked_up", F.col("shown").isNotNull()
    )


def single_corrected() -> Column:
    """What a string cell is rewritten to: trimmed, and in the vocabulary's own case."""
    kind, value, shown = F.col("type"), F.col("value"), F.col("shown")
    return (
        F.when(kind != "string", value)
        .when(~F.col("looked_up"), strip(value))
        .when(F.col("entry").isNull(), value)
        .when(F.array_contains("spellings", shown), shown)
        .otherwise(F.col("entry"))
    )


LIST_KEY = ["vocab_id", "value"]


def with_lists(records: DataFrame, rules: DataFrame) -> DataFrame:
    """The records of types that have a list property with a vocabulary: no other makes a cell for list_terms."""
    kinds = rules.filter(F.col("vocab_id").isNotNull() & F.col("type").isin(*LIST_TYPES)).select(*RULE_ON[:3]).distinct()
    return records.join(kinds, list(RULE_ON[:3]), "left_semi")


def list_terms(cells: DataFrame, index: DataFrame, delimiter: str = "|") -> DataFrame:
    """List cells with a vocabulary. Each distinct list text is split and matched once.

    ``items`` holds (pos, shown, entry, advice) of the items; ``corrected`` is the joined list when
    every item is in the vocabulary. List cells are few among all that are looked at for them, so they are stored, and
    so are their distinct texts.
    """
    rows = stage(
        cells.filter(has_value() & F.col("vocab_id").isNotNull() & F.col("type").isin(*LIST_TYPES)).select(
            *PLACE, "prop", "type", "value", "original", "vocab_id", "cde_missing"), "lists")
    distinct = stage(counted(rows, LIST_KEY), "list-texts")
    pieces = distinct.select(
        *LIST_KEY, F.posexplode(split_plain(F.col("value"), F.lit(delimiter))).alias("pos", "item")
    ).withColumn("shown", strip(F.col("item"))).withColumn("term", F.lower("shown"))
    matched = pieces.join(index, ["vocab_id", "term"], "left").withColumn(
        "fixed", F.when(F.array_contains("spellings", F.col("shown")), F.col("shown")).otherwise(F.col("entry"))
    )
    # One list text is one cell's content, so the groups are as small as that cell.
    outcome = matched.groupBy(*LIST_KEY).agg(
        F.array_sort(F.collect_list(F.struct("pos", "shown", "entry", "advice", "fixed"))).alias("items")
    )
    facts = distinct.join(outcome, LIST_KEY).withColumn(
        "corrected",
        F.when(
            F.forall("items", lambda i: i["entry"].isNotNull()),
            F.array_join(F.transform("items", lambda i: i["fixed"]), delimiter),
        ),
    )
    return attach(rows, facts, LIST_KEY, "n_rows", spread_by=["record_id"]).drop("n_rows")


def _m010(shown: Column, advice: Column) -> Column:
    base = F.format_string('%s "%s" is not a permissible value for property "%s".', prefix(), shown, F.col("prop"))
    hint = F.format_string(
        ' It is recommended to use "%s", as it is semantically equivalent to "%s"', advice, shown
    )
    return F.concat(base, F.when(advice.isNotNull(), hint).otherwise(F.lit("")))


def vocabulary_faults() -> dict[str, Column]:
    """D11 (M010) with the advice of D12, on cells that went through with_terms."""
    shown = F.col("shown")
    return {
        "M010": fault("M010", F.col("looked_up") & F.col("entry").isNull(), F.col("prop"), shown,
                      description=_m010(shown, F.col("advice")))
    }


def list_issues(lists: DataFrame) -> DataFrame:
    """D18 (M010): one row per list item outside the vocabulary."""
    bad = lists.select(
        *ISSUE_KEYS, "file_name", "line_number", "prop",
        F.inline(F.filter("items", lambda i: i["entry"].isNull())),
    )
    text = _m010(F.col("shown"), F.col("advice"))
    return emit(bad, [fault("M010", F.lit(True), F.col("prop"), F.col("shown"), description=text)])


# --- corrections -------------------------------------------------------------------------------


def corrections(matched: DataFrame, lists: DataFrame) -> DataFrame:
    """(record_id, prop, new_value) of every value the checks rewrite; unchanged values are left out.

    ``matched``: all cells after named_cells and with_terms; ``lists``: list_terms of the same cells.
    """
    keep = ("submission_id", "record_id", "prop", "original")
    kind, value = F.col("type"), F.col("value")
    listed = F.col("vocab_id").isNotNull() & kind.isin(*LIST_TYPES)
    # Cells of other types keep their value, so they need no look at the vocabulary unless it is a registered name.
    may_change = F.coalesce(kind.isin("string", "boolean"), F.lit(True)) | ~value.eqNullSafe(F.col("original"))
    simple = matched.filter(has_value() & ~listed & may_change).select(
        *keep,
        F.when(kind == "boolean", F.coalesce(typed.as_flag(value), value))
        .otherwise(single_corrected()).alias("new_value"),
    )
    # A list whose vocabulary element is missing is never rewritten.
    multi = lists.filter(F.col("corrected").isNotNull() & ~F.col("cde_missing")).select(
        *keep, F.col("corrected").alias("new_value")
    )
    return simple.unionByName(multi).filter(~F.col("new_value").eqNullSafe(F.col("original")))


def corrected_records(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Records with the rewritten values in place. Only changed cells travel."""
    per_record = changes.groupBy("record_id").agg(
        F.map_from_entries(F.collect_list(F.struct("prop", "new_value"))).alias("_changes")
    )
    merged = F.when(
        F.col("_changes").isNull(), F.col("props")
    ).otherwise(
        F.transform_values(
            "props",
            lambda k, v: F.when(F.map_contains_key(F.col("_changes"), k), F.col("_changes")[k]).otherwise(v),
        )
    )
    return records.join(per_record, "record_id", "left").withColumn("props", merged).drop("_changes")


# --- D19 ---------------------------------------------------------------------------------------


def concept_codes_of(cells: DataFrame, codes: DataFrame, delimiter: str = "|") -> DataFrame:
    """(record, '<prop>_concept_code', codes joined) for vocabulary-backed properties.

    Matched on the text as handed in, case and all. Each distinct text is split and looked up once. Such cells are stored,
    as all others are looked at for them.
    """
    key = ["concept_cde", "value"]
    rows = stage(cells.filter(
        has_value() & F.col("concept_cde").isNotNull() & (F.col("type") != "pattern")
    ).select("submission_id", "record_id", "prop", *key), "concept-cells")
    distinct = stage(counted(rows, key), "concept-texts")
    pieces = distinct.select(
        *key, F.posexplode(split_plain(F.col("value"), F.lit(delimiter))).alias("pos", "item")
    ).withColumn("pv", strip(F.col("item")))
    known = codes.groupBy(F.col("cde_code").alias("concept_cde"), "pv").agg(F.min("concept_code").alias("one"))
    joined = (
        pieces.join(known, ["concept_cde", "pv"])
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "one"))).alias("found"))
    )
    facts = distinct.join(joined, key, "left").withColumn(
        "codes", F.coalesce(F.array_join(F.transform("found", lambda f: f["one"]), delimiter), F.lit(""))
    ).drop("found")
    return attach(rows, facts, key, "n_rows", spread_by=["record_id"]).select(
        "submission_id", "record_id", F.concat("prop", F.lit("_concept_code")).alias("prop"),
        F.col("codes").alias("value"),
    )


# --- written back ------------------------------------------------------------------------------

ENTRY = "struct<prop: string, value: string>"


def written_back(
    records: DataFrame, issues: DataFrame, fixes: DataFrame, generated: DataFrame, consent: DataFrame, now: Column
) -> DataFrame:
    """Records as a check leaves them: corrected values, generated ones, consent codes, status and the id of their QC row.

    ``fixes``: record_id, prop, new_value; ``generated``: record_id, prop, value; ``consent``: record_id, codes. All that
    concerns a record meets in one grouping, which counts issues before they are shuffled; then it joins the record.
    """
    kinds = {
        "fix": fixes.select("record_id", F.struct("prop", F.col("new_value").alias("value")).cast(ENTRY).alias("fix")),
        "made": generated.select("record_id", F.struct("prop", "value").cast(ENTRY).alias("made")),
        "codes": consent.select("record_id", "codes"),
        "severity": issues.select("record_id", "severity"),
    }
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds.values())
    per_record = both.groupBy("record_id").agg(
        F.map_from_entries(F.collect_list("fix")).alias("_fixes"), F.map_from_entries(F.collect_list("made")).alias("_made"),
        F.max("codes").alias("_codes"), F.count_if(F.col("severity") == ERROR).alias("_errors"),
        F.count_if(F.col("severity") == WARNING).alias("_warnings"),
    )
    joined = records.join(per_record, "record_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("_errors", "_warnings")}
    )
    fixed = F.transform_values(
        "props", lambda k, v: F.when(F.map_contains_key(F.col("_fixes"), k), F.col("_fixes")[k]).otherwise(v)
    )
    failing = (F.col("_errors") > 0) | (F.col("_warnings") > 0)
    return joined.withColumns(
        {
            "props": F.when(F.size("_fixes") > 0, fixed).otherwise(F.col("props")),
            "generated_props": F.coalesce("_made", F.create_map().cast("map<string,string>")),
            "consent_codes": F.col("_codes"),
            "status": F.when(F.col("_errors") > 0, ERROR).when(F.col("_warnings") > 0, WARNING).otherwise(PASSED),
            "issue_id": F.when(failing, F.concat(F.lit("qc:"), "record_id")),
            "validated_at": now, "updated_at": now,
        }
    ).drop("_fixes", "_made", "_codes", "_errors", "_warnings")


# --- all together ------------------------------------------------------------------------------


def property_issue_parts(records, facts, matched: DataFrame, lists: DataFrame, among=None) -> list[DataFrame]:
    """All coded issues of the property checks; the narrow ones share one pass over the cells."""
    return [
        record_issues(records, facts),
        duplicate_issues(records, facts, among).drop("n_copies"),
        cell_issues(matched, required_faults(), name_faults(), type_faults(), vocabulary_faults(),
                    keep=(*ISSUE_KEYS, "data_commons")),
        list_issues(lists),
    ]
