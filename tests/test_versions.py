from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tabgate.operators.versions import BUCKET, VersionConflict, VersionedTable

SHAPE = "id long, part string, v long"


@pytest.fixture()
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), SHAPE, "part", buckets=5)


def some(spark, n, v=0):
    return spark.range(n).select("id", F.concat(F.lit("p "), (F.col("id") % 7).cast("string")).alias("part"), F.lit(v).cast("long").alias("v"))


def content(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_versions_stay_readable(spark, table):
    assert table.read().count() == 0 and table.manifest().version == 0
    assert table.upsert(some(spark, 30), ["part", "id"]) == 1
    first = table.read()
    assert table.upsert(some(spark, 40, 5).filter("id % 2 = 0"), ["part", "id"]) == 2
    assert table.delete(some(spark, 40).filter("part = 'p 3' OR id < 10"), ["part", "id"]) == 3
    want = {i: (0 if i % 2 else 5) for i in range(40) if i < 30 or i % 2 == 0}
    assert content(first) == content(table.read(1)) == content(some(spark, 30))
    assert {r.id: r.v for r in table.read(2).collect()} == want
    assert {r.id for r in table.read().collect()} == {i for i in want if i % 7 != 3 and i >= 10}
    with pytest.raises(ValueError, match="version 9"):
        table.read(9)


def test_failed_writes_are_not_seen(spark, table):
    table.upsert(some(spark, 20), ["part", "id"])
    before = content(table.read())

    def lost():
        raise OSError("the writer is gone")

    with pytest.raises(OSError):
        table.change(some(spark, 20), lambda old: old.withColumn("v", F.lit(9).cast("long")), before_publishing=lost)
    broken = some(spark, 20).withColumn("v", F.raise_error(F.lit("in the middle")).cast("long"))
    with pytest.raises(Exception, match="in the middle"):
        table.upsert(broken, ["part", "id"])
    with pytest.raises(ValueError, match="didn't name"):
        table.change(some(spark, 1), lambda old: some(spark, 20))
    assert table.versions() == [1] and content(table.read()) == before
    assert table.upsert(some(spark, 1, 3), ["part", "id"]) == 2
    assert {r.v for r in table.read().filter("id = 0").collect()} == {3}


def test_the_slower_of_two_writers_fails(spark, table):
    table.upsert(some(spark, 10), ["part", "id"])
    other = VersionedTable(spark, table.path, SHAPE, "part", buckets=5)
    with pytest.raises(VersionConflict):
        table.change(some(spark, 10), lambda old: old, before_publishing=lambda: other.upsert(some(spark, 10, 1), ["part", "id"]))
    assert table.versions() == [1, 2] and {r.v for r in table.read().collect()} == {1}
    assert os.listdir(f"{table.path}/drafts") == [] or all(n.endswith(".crc") for n in os.listdir(f"{table.path}/drafts"))


def test_a_replayed_epoch_changes_nothing(spark, table):
    assert table.upsert(some(spark, 10), ["part", "id"], mark=("load", 4)) == 1
    for epoch in (4, 3):
        assert table.upsert(some(spark, 12, 8), ["part", "id"], mark=("load", epoch)) == 1
    assert table.upsert(some(spark, 12, 8), ["part", "id"], mark=("load", 5)) == 2
    assert table.upsert(some(spark, 12, 9), ["part", "id"], mark=("other", 0)) == 3
    assert table.manifest().marks == {"load": 5, "other": 0}


def test_untouched_buckets_keep_their_files(spark, table):
    table.upsert(some(spark, 70), ["part", "id"])
    old = table.manifest().parts
    table.upsert(some(spark, 7, 1).filter("part = 'p 2'"), ["part", "id"])
    new = table.manifest().parts
    (bucket,) = [r[0] for r in some(spark, 7).filter("part = 'p 2'").select(table.bucket()).collect()]
    assert {b for b in old if old[b] != new[b]} == {bucket}


def test_emptied_buckets_and_null_keys(spark, table):
    rows = some(spark, 14).unionByName(spark.sql("SELECT 99L AS id, CAST(NULL AS STRING) AS part, 1L AS v"))
    table.upsert(rows, ["part", "id"])
    assert table.read().filter("part IS NULL").count() == 1
    table.delete(some(spark, 14), ["part", "id"])
    assert [r.id for r in table.read().collect()] == [99]


def test_forgotten_versions_free_their_rows(spark, table):
    for v in range(4):
        table.upsert(some(spark, 20, v).filter(F.col("id") % 7 <= 3 - v), ["part", "id"])
    want = content(table.read())
    assert table.forget(keep=1) == [4] and table.versions() == [4]
    assert content(table.read()) == want
    kept = {f"data/{d}/{b}" for d in os.listdir(f"{table.path}/data") for b in os.listdir(f"{table.path}/data/{d}") if b.startswith(BUCKET)}
    assert kept == set(table.manifest().parts.values())
