"""Refreshing vocabularies from a dump (L1-L6), and rule rows from raw definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgate.functions.text import strip
from tabgate.operators.rules import KNOWN_TYPES
from tabgate.operators.upkeep import insert_absent
from tabgate.sources import json_array

# Field names as they stand in the dump.
DUMP = """
  CDECode STRING, CDEVersion STRING, CDEFullName STRING,
  permissibleValues ARRAY<STRUCT<value: STRING, ncit_concept_code: STRING, synonyms: ARRAY<STRING>>>
"""


def read_dump(spark: SparkSession, *paths: str) -> DataFrame:
    """The elements of JSON arrays, with path and position. A large array is read in parallel splits."""
    return json_array.read_objects(spark, DUMP, *paths)


def elements(dump: DataFrame, position: Column | None = None) -> DataFrame:
    """L1, L2: code, version, full_name, pvs and the raw values; the first of each (code, version), by default as they stand in
    the files."""
    at = position if position is not None else F.struct("path", "position")
    named = dump.withColumn("_at", at).filter((F.coalesce("CDECode", F.lit("")) != "") & (F.col("CDECode") != "null"))
    version = F.when(~F.coalesce("CDEVersion", F.lit("")).isin("", "null"), F.col("CDEVersion"))
    rows = named.select(
        F.col("CDECode").alias("code"), version.alias("version"),
        F.struct(F.col("CDEFullName").alias("full_name"), F.col("permissibleValues").alias("raw")).alias("body"), "_at",
    )
    first = rows.groupBy("code", "version").agg(F.min_by("body", "_at").alias("body"))
    return first.select(
        "code", "version", F.col("body.full_name").alias("full_name"), value_list(F.col("body.raw")).alias("pvs"),
        F.col("body.raw").alias("raw"),
    )


def value_list(raw: Column) -> Column:
    """L2: trimmed values; none at all, or a link among them, makes the list null."""
    values = F.filter(F.transform(raw, lambda v: v["value"]), lambda v: v.isNotNull())
    linked = F.exists(values, lambda v: v.startswith("http:") | v.startswith("https:"))
    return F.when(F.exists(values, lambda v: v != "") & ~linked, F.transform(values, strip))


def synonym_pairs(first: DataFrame) -> DataFrame:
    """L3: distinct (synonym, term); only elements whose first value has synonyms count."""
    lead = F.get("raw", F.lit(0))["synonyms"]
    rows = first.filter(F.coalesce(F.size(lead) > 0, F.lit(False)))
    values = rows.select(F.explode("raw").alias("v"))
    return values.select(F.explode("v.synonyms").alias("synonym"), F.col("v.value").alias("term")).filter(
        F.coalesce("synonym", F.lit("")) != ""
    ).distinct()


def concept_triples(first: DataFrame) -> DataFrame:
    """L4: distinct (cde_code, pv, concept_code); only elements whose first value has a code count."""
    lead = F.get("raw", F.lit(0))["ncit_concept_code"]
    rows = first.filter(F.coalesce(lead, F.lit("")) != "")
    return rows.select("code", F.explode("raw").alias("v")).select(
        F.col("code").alias("cde_code"), F.col("v.value").alias("pv"), F.col("v.ncit_concept_code").alias("concept_code")
    ).filter(F.coalesce("concept_code", F.lit("")) != "").distinct()


def upserted_elements(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Elements of the same code and version (null equals null) get the new name and list."""
    s, f = stored.alias("s"), fresh.select("code", "version", "full_name", "pvs").alias("f")
    same = (F.col("s.code") == F.col("f.code")) & F.col("s.version").eqNullSafe(F.col("f.version"))
    joined = s.join(f, same, "full")
    is_fresh = F.col("f.code").isNotNull()
    return joined.select(
        F.coalesce("s.code", "f.code").alias("code"), F.coalesce("s.version", "f.version").alias("version"),
        F.when(is_fresh, F.col("f.full_name")).otherwise(F.col("s.full_name")).alias("full_name"),
        F.when(is_fresh, F.col("f.pvs")).otherwise(F.col("s.pvs")).alias("pvs"),
        F.when(~is_fresh, "kept").when(F.col("s.code").isNull(), "inserted").otherwise("updated").alias("change"),
    )


def appended(stored: DataFrame, fresh: DataFrame, fields: list[str]) -> DataFrame:
    """Stored synonyms or concept codes, and the distinct fresh ones that are not there yet (``added``)."""
    new = insert_absent(stored, fresh, fields).withColumn("added", F.lit(True))
    return stored.select(*fields, F.lit(False).alias("added")).unionByName(new)


# --- rule rows ---------------------------------------------------------------------------------

TERM = "STRUCT<Code: STRING, Version: STRING, Origin: STRING>"


def first_registered(terms: Column) -> Column:
    """The first term whose origin names the registry of data elements."""
    # Fixed value: the registry's name as it stands in model files.
    return F.get(F.filter(terms, lambda t: F.coalesce(t["Origin"].contains("caDSR"), F.lit(False))), F.lit(0))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("true", "yes"), F.lit(False))


def rule_rows(definitions: DataFrame) -> DataFrame:
    """Raw property definitions -> rule rows, for all models at once.

    ``definitions``: data_commons, model_version, node_type, prop, kind (type name given as text),
    value_type and pattern (given as a mapping), listing (given as a list), enum, units, required,
    minimum, maximum, exclusive_minimum, exclusive_maximum, terms.
    """
    text = F.col("kind")
    from_text = F.when(text.isin(*KNOWN_TYPES), F.lower(text)).otherwise(F.lit("string"))
    type_ = (
        F.when(text.isNotNull(), from_text)
        .when(F.col("value_type") == "list", F.lit("value-list"))
        .when(F.col("value_type").isNotNull(), F.col("value_type"))
        .when(F.col("pattern").isNotNull(), F.lit("pattern"))
        .otherwise(F.lit("string"))
    )
    plain = F.filter("enum", lambda v: ~v.contains("://"))
    own = F.when(F.size("listing") > 0, F.col("listing")).when(
        F.col("value_type").isNotNull() & (F.size(plain) > 0), plain
    )
    low = F.coalesce("exclusive_minimum", "minimum")
    high = F.coalesce("exclusive_maximum", "maximum")
    term = first_registered(F.col("terms"))
    keys = ("data_commons", "model_version", "node_type")
    rules = definitions.select(
        *keys, "prop", type_.alias("type"), truthy(F.col("required")).alias("required"), low.alias("min"),
        F.when(low.isNotNull(), F.col("exclusive_minimum").isNotNull()).alias("min_exclusive"), high.alias("max"),
        F.when(high.isNotNull(), F.col("exclusive_maximum").isNotNull()).alias("max_exclusive"),
        F.when(type_ == "pattern", F.col("pattern")).alias("pattern"), own.alias("pvs"),
        term["Code"].alias("cde_code"), term["Version"].alias("cde_version"),
    )
    unit = definitions.filter(F.col("value_type").isNotNull() & (F.size("units") > 0)).select(
        *keys, F.concat("prop", F.lit("_unit")).alias("prop"), F.lit("string").alias("type"),
        F.lit(False).alias("required"), F.array_distinct("units").alias("pvs"),
    )
    return rules.unionByName(unit, allowMissingColumns=True)


def relation_rules(ends: DataFrame, nodes: DataFrame, default: str) -> DataFrame:
    """Relationship end points -> (node_type, parent_type, multiplicity).

    ``ends``: data_commons, model_version, relation, source, target, own_multiplicity,
    relation_multiplicity, position. An end point's own multiplicity wins over the relationship's; an
    unknown one of the relationship falls back to ``default``, an unknown one of the end point drops
    it. The last definition of a pair stands.
    """
    # Allowed multiplicities.
    allowed = ("many_to_one", "one_to_one", "many_to_many")
    general = F.when(F.lower("relation_multiplicity").isin(*allowed), F.col("relation_multiplicity")).otherwise(
        F.lit(default)
    )
    rows = ends.withColumn("multiplicity", F.coalesce("own_multiplicity", general)).filter(
        F.col("multiplicity").isin(*allowed)
    )
    known = nodes.select("data_commons", "model_version", F.col("node_type").alias("source"))
    return (
        rows.join(known, ["data_commons", "model_version", "source"], "left_semi")
        .groupBy("data_commons", "model_version", F.col("source").alias("node_type"), F.col("target").alias("parent_type"))
        .agg(F.max_by("multiplicity", "position").alias("multiplicity"))
    )
