"""Reading the tables, and keeping intermediate ones in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgate.session import stage  # noqa: F401

__all__ = ["bounded_batches", "row_key", "stage", "table"]


#: Stands for a null id in keys.
NO_ID = -(1 << 63)


BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Rows reach Python in batches of BATCH_ROWS at most: with whole texts, Spark's default of 10,000 rows fills
    hundreds of MB on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str = "text", doc_id: str = "doc_id") -> tuple[Column, Column]:
    """Two columns that are equal only for rows with the same id and text; such rows get the same results."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col(text)).alias("_key")
