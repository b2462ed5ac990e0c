"""Changes to stored tables (K1-K6) as new table contents; ``versions`` writes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K1: rows of ``new`` replace rows of the same key, others are added."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def update_fields(old: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """K2: chosen fields of matched rows take the new value, nulls included."""
    marked = changes.select(*keys, F.struct(*fields).alias("_new"))
    joined = old.join(marked, keys, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in old.columns
        ]
    )


def replace_issues(issues: DataFrame, validated: DataFrame, found: DataFrame) -> DataFrame:
    """K3: old issues of validated records go, found ones come."""
    return issues.join(validated.select("record_id").distinct(), "record_id", "left_anti").unionByName(found)


def delete_records(records: DataFrame, issues: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K4: records of the given (submission_id, node_type, node_id) and their issues go."""
    key = ["submission_id", "node_type", "node_id"]
    wanted = nodes.select(*key).distinct()
    gone = records.join(wanted, key, "left_semi").select("record_id")
    return records.join(wanted, key, "left_anti"), issues.join(gone, "record_id", "left_anti")


def insert_absent(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """K5: the distinct rows of ``new`` that are not there yet, nulls compared as equal."""
    fresh = new.select(*fields).distinct().alias("n")
    have = old.select(*fields).alias("o")
    same: Column = reduce(lambda a, b: a & b, [F.col(f"n.{f}").eqNullSafe(F.col(f"o.{f}")) for f in fields])
    return fresh.join(have, same, "left_anti")


def ids_except(records: DataFrame, submission_id: str, node_type: str, excluded: DataFrame) -> DataFrame:
    """K6: distinct ids of a type in a submission, without the excluded ones (node_id)."""
    ids = records.filter(
        (F.col("submission_id") == submission_id) & (F.col("node_type") == node_type)
    ).select("node_id").distinct()
    return ids.join(excluded.select("node_id"), "node_id", "left_anti")
