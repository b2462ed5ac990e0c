"""Checks of data files against their records (H1-H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.functions.faults import emit, fault, first_of
from tabgate.messages import ERROR
from tabgate.operators.issues import rank, status_of
from tabgate.operators.lookup import attach, counted
from tabgate.session import stage

NAME = ["submission_id", "file_name"]
SUM = ["submission_id", "md5"]
CONTENT = ["submission_id", "file_name", "md5"]
KEEP = ("submission_id", "record_id", "file_name")


def file_rows(records: DataFrame) -> DataFrame:
    """File records, flat."""
    return records.select(
        "submission_id", "record_id", F.col("file_info").isNotNull().alias("has_info"),
        F.col("file_info.file_name").alias("file_name"), F.col("file_info.size").alias("size"),
        F.col("file_info.md5").alias("md5"), F.col("file_info.status").alias("file_status"),
    )


def reusable_checksums(listing: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose stored checksum still holds, files to hash).

    A stored checksum holds when the file has not been modified since it was taken.
    """
    known = cache.select(*NAME, F.col("md5").alias("stored_md5"), F.col("modified_at").alias("stored_at"))
    joined = listing.join(known, NAME, "left").withColumn(
        "holds", F.coalesce(F.col("modified_at") <= F.col("stored_at"), F.lit(False))
    )
    good = joined.filter("holds").select(*listing.columns, F.col("stored_md5").alias("md5"))
    return good, joined.filter(~F.col("holds")).select(*listing.columns)


def same_content(files: DataFrame) -> DataFrame:
    """H4: per (submission, name, md5): how many records share it, and whether the name has another
    md5 or the md5 another name. Counts of counts; records are never paired."""
    triples = stage(counted(files.filter(F.col("has_info")).select(*CONTENT), CONTENT, name="n_same"), "contents")
    names = counted(triples.select(*NAME), NAME, name="n_sums").filter(F.col("n_sums") > 1)
    sums = counted(triples.select(*SUM), SUM, name="n_names").filter(F.col("n_names") > 1)
    with_names = attach(triples, names, NAME, "n_sums", spread_by=["md5"])
    return attach(with_names, sums, SUM, "n_names", spread_by=["file_name"])


def file_issues(files: DataFrame, listing: DataFrame) -> DataFrame:
    """H1-H4, the first failing check of every record.

    ``listing``: submission_id, file_name, actual_size, actual_md5, one row per stored file.
    """
    stored = listing.join(counted(files.select(*NAME), NAME, name="n_records"), NAME).withColumn(
        "is_stored", F.lit(True)
    )
    seen = attach(files, stored, NAME, "n_records", spread_by=["record_id"])
    rows = attach(seen, same_content(files), CONTENT, "n_same", spread_by=["record_id"])
    name, size, md5 = F.col("file_name"), F.col("size"), F.col("md5")
    incomplete = (F.coalesce(name, F.lit("")) == "") | (F.coalesce(size, F.lit(0)) == 0) | (F.coalesce(md5, F.lit("")) == "")
    first = first_of(
        fault("F009", ~F.col("has_info"), "s3FileInfo", ""),
        fault("F010", incomplete, "fileName", ""),
        fault("F001", F.col("is_stored").isNull(), "file", name, name),
        fault("F003", size != F.col("actual_size"), "file size", size, name, size, F.col("actual_size")),
        fault("F004", md5 != F.col("actual_md5"), "md5", md5, name, md5, F.col("actual_md5")),
        fault("F005", F.col("n_same") > 1, "file name", name, name),
        fault("F006", F.col("n_sums").isNotNull(), "file name", name, name),
        fault("F007", F.col("n_names").isNotNull(), "file name", name, name),
    )
    return emit(rows, [first], keep=KEEP)


def without_logs(listing: DataFrame) -> DataFrame:
    """The listing without paths in a log folder."""
    return listing.filter(~F.col("path").contains("/log"))


def orphans(listing: DataFrame, files: DataFrame, batches: DataFrame) -> DataFrame:
    """H5 (F008): stored files no record names, with the latest uploaded batch that names them.

    ``batches``: batch_id, submission_id, type, status, display_id, files ARRAY<STRING>. Submissions
    without any file record are left out, as there is nothing to compare with.
    """
    described = files.filter(F.col("has_info"))
    bare = (
        without_logs(listing)
        .join(described.select("submission_id").distinct(), "submission_id", "left_semi")
        .join(described.select(*NAME).distinct(), NAME, "left_anti")
    )
    named = batches.filter((F.col("type") == "data file") & (F.col("status") == "Uploaded")).select(
        "submission_id", "batch_id", "display_id", F.explode("files").alias("file_name")
    ).groupBy(*NAME).agg(F.max(F.struct("display_id", "batch_id")).alias("batch"))
    rows = bare.join(named, NAME, "left").withColumn("batch_id", F.coalesce("batch.batch_id", F.lit("-")))
    return emit(
        rows,
        [fault("F008", F.lit(True), "file name", F.col("file_name"), F.col("file_name"))],
        keep=("submission_id", "file_name", "batch_id"),
    )


def submission_file_status(files: DataFrame, issues: DataFrame, found_orphans: DataFrame) -> DataFrame:
    """H6: orphans or any error -> Error, any warning -> Warning, else Passed; no row without file records."""
    per_submission = files.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_files"))
    worst = issues.groupBy("submission_id").agg(F.max(rank(F.col("severity"))).alias("rank"))
    extra = found_orphans.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_orphans"))
    joined = per_submission.join(worst, "submission_id", "left").join(extra, "submission_id", "left")
    state = F.when(F.col("n_orphans") > 0, ERROR).otherwise(status_of(F.coalesce("rank", F.lit(0))))
    return joined.select(
        "submission_id", "n_files", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), state.alias("status")
    )


