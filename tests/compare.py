"""Run queries and their SQL side by side: python tests/compare.py [folder] [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tabgate.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(columns), ), sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, name: str, sf_dir: str, connection) -> str:
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got[1])} rows {seconds:.1f}s"
    result = connection.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    if got == want:
        return f"ok {len(got[1])} rows {seconds:.1f}s"
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} <> {want[0]}"
    extra, lost = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return (
        f"DIFFERENT {len(got[1])} rows, expected {len(want[1])}; extra {len(extra)} e.g. {sorted(extra)[:3]};"
        f" lost {len(lost)} e.g. {sorted(lost)[:3]}"
    )


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for query in entry.queries():
        if not wanted or any(query.startswith(w) for w in wanted):
            try:
                outcome = compare(session, query, folder, con)
            except Exception as problem:  # report and go on
                outcome = f"FAILED {type(problem).__name__}: {str(problem)[:600]}"
            print(f"@@ {query}: {outcome}", flush=True)
