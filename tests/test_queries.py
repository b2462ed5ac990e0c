"""Queries against their SQL. All of them: TABGATE_ALL=1, or python tests/compare.py."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = os.environ.get("TABGATE_DATA", "/root/testdata/sf0.001")
SOME = (
    "a01_tsv_scan", "b14_b15_repeated_ids", "c05_merged_rows", "d05_required_blank", "d11_permitted_values", "d15_bounds",
    "e04_absent_parents", "f04_cross_submission", "h01_h04_file_issues", "i02_cascade", "j09_release_properties",
    "l05_upserted_elements", "n03_issue_codes", "s03_running_status",
)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("TABGATE_ALL") else SOME)
def test_query(spark, name):
    outcome = compare(spark, name, FOLDER, connect(FOLDER))
    assert outcome.startswith(("ok", "rows-only")), outcome


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8 and {r["status"] for r in rows} <= {"Error", "Warning", "Passed"}
