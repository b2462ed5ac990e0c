"""Rule tables: effective vocabularies and the index that values are matched against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.functions.text import DELETE_MARK, strip

RULE_KEY = ("data_commons", "model_version", "node_type", "prop")
# Property types a model may declare.
KNOWN_TYPES = ("string", "integer", "number", "datetime", "date", "boolean", "value-list", "array", "pattern")


def anchored_pattern(pattern: Column) -> Column:
    """The pattern as it is matched: whole values, and named groups as the matching engine writes them."""
    return F.concat(F.lit("^(?:"), F.replace(pattern, F.lit("(?P<"), F.lit("(?<")), F.lit(")"))


def with_pattern_state(model_props: DataFrame) -> DataFrame:
    """Adds pattern_ok: does the pattern compile in the engine that matches values later?"""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), anchored_pattern(F.col("pattern")))
    return model_props.withColumn("pattern_ok", F.col("pattern").isNotNull() & compiled.isNotNull())


def effective_rules(model_props: DataFrame, cde: DataFrame) -> DataFrame:
    """The vocabulary each property is really checked against.

    An own list stands unless a vocabulary element is named. The element is the requested version,
    or the highest version as text. Its list replaces the own one when it has entries, switches the
    check off when it is empty, and leaves the own list when it is null or the element is missing.
    """
    by_version = cde.groupBy("code", "version").agg(F.max(F.struct("pvs")).alias("one"))
    latest = (
        cde.groupBy("code")
        .agg(F.max_by(F.struct("pvs", "version"), F.coalesce("version", F.lit(""))).alias("_latest"))
        .select(F.col("code").alias("_lc"), "_latest")
    )
    exact = by_version.select(
        F.col("code").alias("_c"), F.col("version").alias("_v"),
        F.struct(F.col("one.pvs").alias("pvs"), F.col("version").alias("version")).alias("_exact"),
    )
    wanted = F.nullif(F.col("cde_version"), F.lit(""))
    joined = (
        model_props.withColumn("cde_code", F.nullif(F.col("cde_code"), F.lit("")))
        .join(exact, (F.col("cde_code") == F.col("_c")) & (wanted == F.col("_v")), "left")
        .join(latest, (F.col("cde_code") == F.col("_lc")) & wanted.isNull(), "left")
    )
    element = F.coalesce("_exact", "_latest")
    replaces = element["pvs"].isNotNull()
    effective = F.when(replaces, element["pvs"]).otherwise(F.col("pvs"))
    has_list = F.coalesce(F.size(effective) > 0, F.lit(False))
    from_element = F.coalesce(replaces & (F.size(element["pvs"]) > 0), F.lit(False))
    own_id = F.concat_ws("|", F.lit("own"), *RULE_KEY)
    element_id = F.concat_ws("|", F.lit("cde"), F.col("cde_code"), F.coalesce(element["version"], F.lit("")))
    return joined.select(
        *model_props.columns[: model_props.columns.index("pvs")],
        *[c for c in model_props.columns if c == "pattern_ok"],
        F.when(has_list, F.transform(effective, strip)).alias("pvs"),
        F.when(has_list, F.when(from_element, element_id).otherwise(own_id)).alias("vocab_id"),
        (F.col("cde_code").isNotNull() & element.isNull()).alias("cde_missing"),
        F.when(from_element, F.col("cde_code")).alias("concept_cde"),
    )


def term_index(rules: DataFrame, synonyms: DataFrame) -> DataFrame:
    """One row per (vocabulary, lower-cased text): the entry it stands for and the advice it earns.

    Size follows vocabularies and synonyms, not records.
    """
    lists = rules.filter(F.col("vocab_id").isNotNull()).groupBy("vocab_id").agg(F.first("pvs").alias("pvs"))
    terms = lists.select(
        "vocab_id", F.posexplode(F.concat("pvs", F.array(F.lit(DELETE_MARK)))).alias("pos", "pv")
    )
    entries = terms.groupBy("vocab_id", F.lower("pv").alias("term")).agg(
        F.min_by("pv", "pos").alias("entry"), F.collect_set("pv").alias("spellings")
    )
    advice = (
        synonyms.select(F.lower("synonym").alias("term"), F.col("term").alias("pv"))
        .join(terms, "pv")
        .groupBy("vocab_id", "term")
        .agg(F.min_by("pv", "pos").alias("advice"))
    )
    return entries.join(advice, ["vocab_id", "term"], "full")
