"""Data files in storage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# binaryFile holds a whole file in one cell, which ends at 2 GB; above this size files are hashed
# piece by piece in the tasks.
ONE_CELL = 256 * 1024 * 1024


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """A5: path, name, size and time of every file with content below a folder; contents are not read.

    Spark's reader passes over files of size 0; who asks whether such a file is there has the store's own listing.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    )
    return found.withColumn("file_name", F.element_at(F.split("path", "/"), -1))


def has_data_files(spark: SparkSession, folder: str) -> bool:
    return not listed(spark, folder).limit(1).isEmpty()


def hashed(spark: SparkSession, folder: str, wanted: DataFrame | None = None, one_cell: int = ONE_CELL) -> DataFrame:
    """Path and MD5. ``wanted`` (path) limits the work to those files."""
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = contents.filter(F.col("length") <= one_cell)
    large = contents.filter(F.col("length") > one_cell).select("path")
    if wanted is not None:
        small = small.join(wanted.select("path"), "path", "left_semi")
        large = large.join(wanted.select("path"), "path", "left_semi")
    return small.select("path", F.md5("content").alias("md5")).unionByName(hashed_in_pieces(large))


def hashed_in_pieces(paths: DataFrame) -> DataFrame:
    """MD5 of files too large for one cell, read in pieces by the task that holds the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            sums = []
            for path in batch["path"]:
                uri = "file://" + path[len("file:"):] if path.startswith("file:/") and "://" not in path else path
                store, name = fs.FileSystem.from_uri(uri)
                digest = hashlib.md5()
                with store.open_input_stream(name) as stream:
                    while piece := stream.read(8 * 1024 * 1024):
                        digest.update(piece)
                sums.append(digest.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "md5": sums})

    spread = paths.repartition(F.col("path"))
    return spread.mapInPandas(run, "path STRING, md5 STRING")
