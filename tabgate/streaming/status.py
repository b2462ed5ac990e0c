"""The running status of submissions (S3): a stateful aggregate, kept in a table of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabgate.messages import ERROR, WARNING
from tabgate.operators.issues import rank
from tabgate.operators.versions import VersionedTable

STATUS = "submission_id STRING, rank INT, n_errors BIGINT, n_warnings BIGINT"


def running_status(issues: DataFrame) -> DataFrame:
    """S3: per submission the worst severity and the counts so far; a stateful aggregate whose state
    is one row per submission."""
    return issues.groupBy("submission_id").agg(
        F.max(rank(F.col("severity"))).alias("rank"),
        F.count_if(F.col("severity") == ERROR).alias("n_errors"),
        F.count_if(F.col("severity") == WARNING).alias("n_warnings"),
    )


def keep_latest(status: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """S3: the changed submissions of every micro-batch replace their rows; a replayed one changes nothing, and only
    the two newest versions stay on disk."""

    def handle(changed: DataFrame, epoch: int) -> None:
        table.upsert(changed, ["submission_id"], mark=("status", epoch))
        table.forget(keep=2)

    return (
        status.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
