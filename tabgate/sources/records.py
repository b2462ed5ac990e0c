"""Scans of stored records (A2-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.messages import NEW


def by_scope(records: DataFrame, submission_ids: list[str], scope: str | None = None) -> DataFrame:
    """A2: records of submissions; scope New keeps only new ones, any other scope keeps all."""
    rows = records.filter(F.col("submission_id").isin(*submission_ids))
    return rows.filter(F.col("status") == NEW) if scope == NEW else rows


def by_type(records: DataFrame, submission_id: str, node_type: str) -> DataFrame:
    """A3."""
    return records.filter((F.col("submission_id") == submission_id) & (F.col("node_type") == node_type))


def with_files(records: DataFrame, submission_id: str | None = None) -> DataFrame:
    """A4: records that describe a data file."""
    rows = records.filter(F.col("file_info").isNotNull())
    return rows if submission_id is None else rows.filter(F.col("submission_id") == submission_id)
