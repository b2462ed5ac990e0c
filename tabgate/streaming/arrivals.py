"""Batches of files that arrive bit by bit (S1): checked file by file, decided when whole, loaded at once.

Two queries, each restartable by itself. ``check_arrivals`` checks every arriving file by its own and writes its issues, its
candidate records and one row that tells of it. ``decide_and_load`` reads those rows as a stream and keeps a state for each
batch: the files seen so far and what has been found. The rules:

- A batch is decided once every file it names has been seen: Failed if any has an issue, else Uploaded. Until then it
  waits, however many micro-batches that takes. A batch that can't be processed at all (B1) fails at once.
- Before that, a file that comes again replaces what came before under its name; the same file again changes nothing.
- A decision stands. A file that comes later, or that the batch doesn't name, is reported as late or unlisted, and not loaded.
- With a deadline, a batch that isn't whole by then fails, and tells how many files are missing.

The files of an uploaded batch become records in one change of the record table, marked with the epoch, so a replayed
epoch changes nothing. State has a row for each file of a batch, and one for the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tabgate.operators import load, structure
from tabgate.operators.versions import VersionedTable
from tabgate.schema import EDGES, FILE_INFO
from tabgate.session import stage
from tabgate.sources import tsv

UPLOADED, FAILED, WAITING = "Uploaded", "Failed", "Waiting"
DECIDED, LATE, UNLISTED = "decided", "late", "unlisted"

#: The store of streaming state that transformWithState needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FILE_SEEN = """batch_id STRING, file_name STRING, expected ARRAY<STRING>, reason STRING, n_lines BIGINT, n_issues BIGINT,
  fingerprint BIGINT, epoch BIGINT"""
DECISION = """batch_id STRING, what STRING, status STRING, file_name STRING, epoch BIGINT, n_files BIGINT, n_issues BIGINT,
  n_missing BIGINT, reason STRING"""
LOADED = f"""record_id STRING, submission_id STRING, data_commons STRING, study_id STRING, batch_ids ARRAY<STRING>,
  status STRING, file_name STRING, line_number INT, node_type STRING, node_id STRING, id_prop STRING,
  props MAP<STRING, STRING>, parents {EDGES}, raw_data MAP<STRING, STRING>, file_info {FILE_INFO}, entity_type STRING,
  global_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP, uploaded_date TIMESTAMP"""
BATCH_STATE = "batch_id STRING, status STRING, n_files BIGINT, n_issues BIGINT, n_missing BIGINT, reason STRING"


@dataclass
class Rules:
    """What a check looks things up in, as it stands now.

    ``batches``: batch_id, submission_id, type, files; ``submissions``: submission_id, data_commons, model_version, study_id,
    intention, orcid, omit_prefix.
    """

    batches: DataFrame
    submissions: DataFrame
    model_nodes: DataFrame
    model_props: DataFrame
    model_rels: DataFrame


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of metadata files as they arrive below ``folder``/<batch>/<file>; a file arrives whole."""
    reader = spark.readStream.schema("value STRING").format("text").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return tsv.with_place(reader.load(folder))


def place_in_path(path: Column) -> tuple[Column, Column]:
    """(batch, file) of <batch>/<file>."""
    steps = F.split(path, "/")
    return F.element_at(steps, -2), F.element_at(steps, -1)


def checked_files(lines: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, candidate records, one row per file) of parsed lines: batch_id, file_name, line_number, value, cells.

    B2-B16 and A1b by file; files of batches that can't be processed (B1) are told of, but not looked into.
    """
    reasons = structure.batch_issues(rules.batches.select("batch_id", "submission_id", "type", "files"), rules.submissions, rules.model_nodes)
    gate = rules.batches.select("batch_id", "submission_id", F.col("files").alias("expected")).join(reasons, "batch_id", "left")
    told = lines.join(gate.select("batch_id", "reason"), "batch_id", "left")
    usable = told.filter("reason IS NULL").drop("reason")
    batches = rules.batches.select("batch_id", "submission_id").join(
        rules.submissions.select("submission_id", *structure.MODEL, "intention", "omit_prefix"), "submission_id"
    )
    files, rows = structure.sheet(usable.select(*structure.FILE, "line_number", "cells"), batches, rules.model_nodes)
    found = structure.issues_of(files, rows, rules.model_nodes, rules.model_props, rules.model_rels)
    broken = tsv.unreadable(usable, usable.select(*structure.FILE).distinct(), keys=tuple(structure.FILE))
    issues = stage(
        found.select(*structure.FILE, "kind", "line_number", "what", "text").unionByName(
            broken.select(*structure.FILE, "kind", "line_number", F.lit(None).cast("string").alias("what"), F.col("kind").alias("text"))
        ),
        "arrived-issues",
    )
    bad = issues.groupBy(*structure.FILE).agg(F.count(F.lit(1)).alias("n_issues"))
    good = rows.join(bad, structure.FILE, "left_anti")
    layouts = load.with_layout(files).select(*structure.FILE, "n_lines", *load.LAYOUT)
    placed = structure.attach(good.drop("n_lines"), layouts, structure.FILE, "n_lines", spread_by=["line_number"])
    seen = (
        lines.groupBy(*structure.FILE)
        .agg(F.count(F.lit(1)).alias("n_lines"), F.bit_xor(F.xxhash64("line_number", "value")).alias("fingerprint"))
        .join(bad, structure.FILE, "left").join(gate.drop("submission_id"), "batch_id", "left")
        .withColumn("n_issues", F.coalesce("n_issues", F.lit(0).cast("bigint")))
    )
    return issues, load.merged(load.row_records(placed)), seen


def check_arrivals(
    lines: DataFrame, folder: str, checkpoint: str, rules: Callable[[], Rules],
    place: Callable[[Column], tuple[Column, Column]] = place_in_path,
) -> StreamingQuery:
    """Checks every arriving file once; issues, records and files below ``folder``.

    Each micro-batch writes its own subfolders by overwriting, the files last, so a repeated attempt leaves one copy.
    """

    def handle(arrived: DataFrame, epoch: int) -> None:
        batch, name = place(F.col("path"))
        parsed = tsv.parsed(tsv.numbered(arrived)).withColumns({"batch_id": batch, "file_name": name})
        issues, records, seen = checked_files(stage(parsed.drop("path"), "lines"), rules())
        for label, rows in (("issues", issues), ("records", records), ("files", seen.withColumn("epoch", F.lit(epoch).cast("bigint")))):
            rows.write.mode("overwrite").parquet(f"{folder}/{label}/epoch_{epoch}")

    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class BatchState(StatefulProcessor):
    """The state of one batch: its files seen so far, and its status once decided."""

    def __init__(self, deadline_ms: int | None = None) -> None:
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file_name STRING", "fingerprint BIGINT, n_issues BIGINT, epoch BIGINT")
        self.status = handle.getValueState("status", "status STRING, expected ARRAY<STRING>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (batch,) = key
        arrived = sorted(rows, key=lambda r: (r.epoch, r.file_name))
        state = self.status.get() if self.status.exists() else None
        status, expected = (state[0], state[1]) if state else (None, None)
        if state is None and self.deadline_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.deadline_ms)
        for row in arrived:
            known = self.files.getValue((row.file_name,)) if self.files.containsKey((row.file_name,)) else None
            listed = row.expected is not None and row.file_name in row.expected
            if status is not None:
                if known is None or known[0] != row.fingerprint:
                    yield self._row(batch, LATE if listed else UNLISTED, status, row)
                continue
            if row.reason is not None:
                status, expected = FAILED, []
                yield self._decision(batch, status, None, row.reason)
            elif not listed:
                yield self._row(batch, UNLISTED, WAITING, row)
                continue
            else:
                expected = list(row.expected)
            if known is None or known[0] != row.fingerprint:
                self.files.updateValue((row.file_name,), (row.fingerprint, row.n_issues, row.epoch))
            if status is None and all(self.files.containsKey((name,)) for name in expected):
                seen = {name: self.files.getValue((name,)) for name in set(expected)}
                status = FAILED if any(f[1] for f in seen.values()) else UPLOADED
                for name, found in sorted(seen.items()):
                    yield self._decision(batch, status, (name, *found), None, len(seen), sum(f[1] for f in seen.values()))
        self.status.update((status, expected or []))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, expected = self.status.get() if self.status.exists() else (None, [])
        if status is not None:
            return
        seen = {name: self.files.getValue((name,)) for name in set(expected) if self.files.containsKey((name,))}
        self.status.update((FAILED, list(expected)))
        issues = sum(f[1] for f in seen.values())
        yield self._decision(key[0], FAILED, None, "files are missing", len(seen), issues, len(set(expected)) - len(seen))

    @staticmethod
    def _row(batch: str, what: str, status: str, row: Row) -> Row:
        return Row(batch_id=batch, what=what, status=status, file_name=row.file_name, epoch=row.epoch, n_files=None, n_issues=row.n_issues,
                   n_missing=None, reason=None)

    @staticmethod
    def _decision(batch: str, status: str, file: tuple | None, reason: str | None, n_files: int = 0, n_issues: int = 0, n_missing: int = 0) -> Row:
        """One row per file of a decided batch, or one without a file."""
        return Row(batch_id=batch, what=DECIDED, status=status, file_name=file and file[0], epoch=file and file[3], n_files=n_files,
                   n_issues=n_issues, n_missing=n_missing, reason=reason)


def decisions(files: DataFrame, deadline_ms: int | None = None) -> DataFrame:
    """The decisions on batches, one row per file of a decided one, and the late and unlisted files."""
    time_mode = "None" if deadline_ms is None else "ProcessingTime"
    return files.groupBy("batch_id").transformWithState(BatchState(deadline_ms), DECISION, "Append", time_mode)


def records_of(decided: DataFrame, candidates: DataFrame, rules: Rules, stored: DataFrame, releases: DataFrame, now: Column) -> DataFrame:
    """C5-C8 for the files of uploaded batches: ``candidates`` carry the epoch their file was checked in."""
    key = [*structure.FILE, "epoch"]
    chosen = decided.filter((F.col("what") == DECIDED) & (F.col("status") == UPLOADED) & F.col("file_name").isNotNull())
    about = rules.batches.select("batch_id", "submission_id").join(
        rules.submissions.select("submission_id", *structure.MODEL, "study_id"), "submission_id"
    )
    facts = rules.model_nodes.select(*structure.MODEL, "node_type", "is_main", "is_file", "entity_type")
    rows = candidates.join(chosen.select(*key), key, "left_semi").drop("epoch").join(about, "batch_id").join(
        facts, [*structure.MODEL, "node_type"], "left"
    )
    merged = load.with_stored(load.one_per_node(rows), stored, now)
    return load.with_global_id(merged, stored, releases, rules.submissions)


def decide_and_load(
    spark: SparkSession, folder: str, checkpoint: str, rules: Callable[[], Rules], records: VersionedTable, batches: VersionedTable,
    releases: Callable[[], DataFrame], now: Callable[[], Column] = F.current_timestamp, deadline_ms: int | None = None,
) -> StreamingQuery:
    """Decides on batches from the files checked below ``folder``, loads the uploaded ones and keeps the states.

    The reports on late and unlisted files go to ``folder``/reports. The query ends with what has arrived; with a
    deadline it goes on, as time alone may then decide, until it is stopped.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    seen = spark.readStream.schema(FILE_SEEN).option("recursiveFileLookup", "true").parquet(f"{folder}/files")

    def handle(decided: DataFrame, epoch: int) -> None:
        decided = stage(decided, "decisions")
        found = decided.filter(F.col("what") == DECIDED).groupBy("batch_id", "status").agg(
            *[F.max(c).alias(c) for c in ("n_files", "n_issues", "n_missing", "reason")]
        )
        if not decided.filter((F.col("status") == UPLOADED) & (F.col("what") == DECIDED)).isEmpty():
            new = records_of(decided, checked_records(spark, folder), rules(), records.read(), releases(), now())
            records.upsert(stage(new, "loaded"), load.NODE_KEY, mark=("load", epoch))
        batches.upsert(found, ["batch_id"], mark=("load", epoch))
        decided.filter(F.col("what") != DECIDED).write.mode("overwrite").parquet(f"{folder}/reports/epoch_{epoch}")

    trigger = {"availableNow": True} if deadline_ms is None else {"processingTime": "10 seconds"}
    return (
        decisions(seen, deadline_ms).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger).start()
    )


def checked_records(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate records of all files checked so far, with the epoch of the check."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/records")
    return rows.withColumn("epoch", F.regexp_extract(F.col("_metadata.file_path"), "/epoch_([0-9]+)/", 1).cast("bigint"))


def batch_states(rules: Rules, batches: VersionedTable) -> DataFrame:
    """Every batch with its state; those not decided yet wait."""
    return rules.batches.select("batch_id").join(batches.read(), "batch_id", "left").withColumn(
        "status", F.coalesce("status", F.lit(WAITING))
    )
