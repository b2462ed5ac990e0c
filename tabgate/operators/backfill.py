"""One-off repairs of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Node types of each entity.
ENTITIES = {
    "Program": ("program",),
    "Study": ("study",),
    "Participant": ("participant", "subject", "case"),
    "Sample": ("sample", "specimen"),
    "Principal Investigator": ("principal_investigator", "study_personnel"),
    "File": ("file", "data_file", "clinical_measure_file", "cytogenomic_file", "radiology_file",
             "methylation_array_file", "sequencing_file"),
}
FILE_TYPES = ("file", "data_file", "clinical_measure_file", "cytogenomic_file", "methylation_array_file",
              "pathology_file", "radiology_file", "sequencing_file")
# Issue codes by title.
CODES = {
    "Missing required property": "M003",
    "Invalid integer value": "M004",
    "Invalid number value": "M005",
    "Invalid datetime value": "M006",
    "Invalid date value": "M007",
    "Invalid boolean value": "M008",
    "Invalid property definition": "M009",
    "Value not permitted": "M010",
    "Relationship not specified": "M013",
    "Related node not found": "M014",
    "Identical data found": "M015",
    "Duplicate IDs": "M016",
    "Invalid Property": "M017",
    "Invalid property": "M017",
    "Updating existing data": "M018",
    "Data not found": "M019",
    "Invalid node": "M021",
    "Missing ID property": "M022",
    "Invalid relationship": "M023",
    "One-to-one relationship conflict": "M024",
    "Many-to-one relationship conflict": "M025",
    "Invalid data model": "M026",
    "Invalid record/node type": "M035",
    "Incompatible consent codes": "M036",
    "Data File not found": "F001",
    "Data file not found": "F001",
    "File records not found": "F002",
    "Data file records not found": "F002",
    "Data file size mismatch": "F003",
    "Data file MD5 mismatch": "F004",
    "Duplicated file records detected": "F005",
    "Conflict file records detected": "F006",
    "Duplicated file content detected": "F007",
    "Duplicated data file content detected": "F007",
    "Orphaned file found": "F008",
    "Invalid dataRecord": "F009",
    "Invalid data file info": "F010",
    "Conflict Data found": "S001",
}
# Titles whose code depends on words of the description.
CODES_BY_TEXT = {
    "Value out of range": (("below", "M011"), ("above", "M012")),
    "Internal error": (("Metadata validation", "M020"), ("Data file validation", "F011")),
}
DRAFT_STATES = ("New", "In Progress", "Inquired")


def with_study(rows: DataFrame, submissions: DataFrame) -> DataFrame:
    """Study id of the submission; rows without a submission stay as they are."""
    known = submissions.groupBy("submission_id").agg(F.min("study_id").alias("_study"), F.lit(True).alias("_known"))
    joined = rows.join(known, "submission_id", "left")
    value = F.when(F.col("_known"), F.col("_study")).otherwise(F.col("study_id"))
    return joined.withColumn("study_id", value).select(*rows.columns)


def entity_of(node_type: Column) -> Column:
    picked = F.lit(None).cast("string")
    for entity, types in ENTITIES.items():
        picked = F.when(node_type.isin(*types), F.lit(entity)).otherwise(picked)
    return picked


def with_entity(rows: DataFrame) -> DataFrame:
    """Entity type of known node types; others keep theirs."""
    return rows.withColumn("entity_type", F.coalesce(entity_of(F.col("node_type")), "entity_type"))


def code_of(title: Column, description: Column) -> Column:
    by_title = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    code = F.try_element_at(by_title, title)
    for name, cases in CODES_BY_TEXT.items():
        for words, value in reversed(cases):
            code = F.when((title == name) & F.coalesce(description.contains(words), F.lit(False)), F.lit(value)).otherwise(code)
    return code


def with_codes(rows: DataFrame, field: str) -> DataFrame:
    """Codes of issues that have none, from title and text. ``field``: array of issue structs."""
    def coded(issue: Column) -> Column:
        code = F.when(F.coalesce(issue["code"], F.lit("")) == "", code_of(issue["title"], issue["description"]))
        return issue.withField("code", F.coalesce(code, issue["code"]))

    return rows.withColumn(field, F.transform(field, coded))


def first_status(rows: DataFrame) -> DataFrame:
    """A list of states becomes its first."""
    return rows.withColumn("status", F.get("status", F.lit(0)))


def id_structs(rows: DataFrame, field: str) -> DataFrame:
    """A list of ids becomes a list of structs with that id."""
    return rows.withColumn(field, F.transform(field, lambda x: F.struct(x.alias("_id"))))


def with_file_location(releases: DataFrame, submissions: DataFrame) -> DataFrame:
    """Missing data-file address of file types, from the submission's bucket and root."""
    places = submissions.groupBy("submission_id").agg(F.min(F.struct("bucket_name", "root_path")).alias("_place"))
    joined = releases.join(places, "submission_id", "left")

    def given(prop: str) -> Column:
        return F.nullif(F.try_element_at("props", F.lit(prop)), F.lit(""))

    name = F.coalesce(given("file_name"), given("data_file_name"))
    bucket, root = F.nullif(F.col("_place.bucket_name"), F.lit("")), F.nullif(F.col("_place.root_path"), F.lit(""))
    # A null part makes the whole address null.
    url = F.concat(F.lit("s3://"), bucket, F.lit("/"), F.trim(root), F.lit("/file/"), name)
    missing = F.col("data_file_location").isNull() & F.col("node_type").isin(*FILE_TYPES)
    return joined.withColumn(
        "data_file_location", F.when(missing, url).otherwise(F.col("data_file_location"))
    ).select(*releases.columns)


def with_version(applications: DataFrame) -> DataFrame:
    """Missing version: 2.0 for drafts, 1.0 for the rest."""
    value = F.when(F.col("status").isin(*DRAFT_STATES), "2.0").otherwise("1.0")
    missing = F.col("version").isNull() & F.col("status").isNotNull()
    return applications.withColumn("version", F.when(missing, value).otherwise(F.col("version")))
