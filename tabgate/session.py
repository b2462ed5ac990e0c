"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Staged rows are written once and read a few times; this takes about two thirds of the space of Spark's default.
STAGED = "zstd"
# More pieces than this only make more small files: sizes known to the planner are often too large.
MOST_PIECES = 10_000


def build_session(app: str = "tabgate", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def even_reads(spark: SparkSession) -> None:
    """Rows are read in splits of at most 16 MB, as many are made of each; small files are put together by their size.

    By default a split has up to 128 MB, and a small file counts for 4 MB: then the few largest of a stored table's small
    files, which hold most of its rows, come to one task."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 20))
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 10))
    spark.conf.set("spark.sql.files.minPartitionNum", str(4 * spark.sparkContext.defaultParallelism))


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows dealt by ``keys`` into as many pieces as even_reads asks for. Worth their one move if many jobs read them: the
    few files of a stored table's buckets are as uneven as the keys of its buckets, and one task then waits for one of them."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    pieces = min(max(4 * rows.sparkSession.sparkContext.defaultParallelism, size >> 24), MOST_PIECES)
    return rows.repartition(pieces, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by spark.checkpoint.dir.

    Only a session of one process may fall back to a temporary folder of its own; with executors of
    their own a machine-local path would lose data with the machine, so that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tabgate-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back: computed once, whoever reads them.

    Later plans see a plain scan with known size, column pruning and pushed filters.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", STAGED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(parts: list[DataFrame], label: str) -> DataFrame:
    """Several DataFrames of one shape, computed one after the other into one staged table."""
    spark, shape = parts[0].sparkSession, parts[0].schema
    path = scratch_path(spark, label)
    for at, part in enumerate(parts):
        part.select(*shape.names).write.option("compression", STAGED).parquet(f"{path}/part={at}")
    return spark.read.schema(shape).parquet(*[f"{path}/part={at}" for at in range(len(parts))])
