from __future__ import annotations

import duckdb
import pytest

from tabgate.llm import quality_rules as Q
from tabgate.llm.queries import OP8_SQL


def case() -> list[tuple]:
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(abs(i))) + "n" * (i < 0)
    make = lambda i, n: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(n))  # digits are all alike to the rules
    rows: list[tuple] = [(1, None, "s"), (2, "", "s"), (3, " \n\t ", "s"), (4, "too few words", "s"), (5, "one two three four five six seven eight nine ten", None)]
    rows += [(6, "a b c d e " * 8, "s"), (7, "É é #*$ x|y <z> &% " + make(7, 9), "s"), (7, "É é #*$ x|y <z> &% " + make(7, 9), "s")]
    rows += [(8, "same line here\nsame line here\nsame line here \n\n" + make(8, 12), "s"), (None, make(9, 15), "s"), (10, make(10, 9000), "s")]
    for i in range(100, 160):  # a notice in unlike documents, some of which hold little else
        rows.append((i, f"Subscribe  to Letter {i} of our house today\n" + make(i, 20 if i % 2 else 1) + "\n" + make(-i, 2), "s"))
    for i in range(200, 260):  # copies of one document, exact and near
        rows.append((i, "\n".join(make(500 + k, 14) for k in range(8)) + (f"\nedit {i}" if i % 3 == 0 else ""), "t"))
    return rows


def test_verdicts_equal_sql(spark):
    rows = case()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, n_words int, host string")
    got = sorted(map(repr, (tuple(r) for r in Q.quality_verdicts(docs).drop("_id", "_key").collect())))
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert got == sorted(map(repr, db.execute(OP8_SQL).fetchall()))


def test_depleted_documents_go_and_copies_stay(spark):
    rows = case()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in Q.keep_good(docs).collect()}
    assert {i for i in range(100, 160) if i % 2} <= kept and not {i for i in range(100, 160) if not i % 2} & kept
    assert set(range(200, 260)) <= kept and {None, 10} <= kept and not {1, 2, 3, 4, 6} & kept
    assert Q.keep_good(docs).columns == docs.columns


def test_shuffled_rejection_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(case(), "doc_id long, text string, source string")
    want = sorted(map(repr, Q.keep_good(docs).collect()))
    monkeypatch.setattr(Q, "BROADCAST_ROWS", -1)
    assert sorted(map(repr, Q.keep_good(docs).collect())) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Q.quality_verdicts(docs).collect() == [] == Q.keep_good(docs).collect()


def name(i: int) -> str:
    return "".join(chr(97 + int(c)) for c in str(i))


def prose(i: int, n: int) -> str:
    return " ".join(f"w{name(i)}x{name(k)}" for k in range(n))


@pytest.mark.parametrize("k, m", [(3, 1), (5, 2), (8, 1), (8, 2)])
def test_notices_that_stand_together_are_removed(spark, k, m):
    notices = [prose(90000 + i, 6 + i) for i in range(k)]
    rows = [(d, "\n".join([*notices, *(prose(1000 + 10 * d + i, 5) for i in range(m))]), "s") for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sum(6 + i for i in range(k))
    assert {r.n_removed_words for r in Q.quality_verdicts(docs).collect()} == {want}


def test_a_notice_inside_a_group_of_copies_is_removed(spark):
    notice, text = "Read the terms of this house first", prose(7, 40)
    rows = [(d, notice + "\n" + text + "\n" + prose(8, 30), "s") for d in range(300)]
    rows += [(1000 + d, notice + "\n" + prose(2000 + d, 30), "s") for d in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.n_removed_words for r in Q.quality_verdicts(docs).collect()} == {7}


def test_near_copies_count_once(spark):
    base = [prose(i, 80).split() for i in range(3)]
    rows = []
    for d in range(240):
        lines = [list(x) for x in base]
        lines[d % 3][d // 3] = "edited" + name(d)
        rows.append((d, "\n".join(map(" ".join, lines)), "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.n_removed_words, r.kept) for r in Q.quality_verdicts(docs).collect()} == {(0, True)}


def test_a_notice_on_one_long_line_is_removed(spark):
    licence = prose(5, 120)
    rows = [(d, licence + "\n" + prose(1000 + d, 20 if d % 2 else 90), "s") for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in Q.quality_verdicts(docs).collect()}
    assert got == {d: (120, d % 2 == 0) for d in range(60)}


def slow_clean(rows: list[tuple], removed: dict[str | None, set[int]], kept: set) -> list[tuple]:
    out = []
    for d, text, host in rows:
        if (d, text, host) in kept:
            out.append((d, "\n".join(x for x in text.split("\n") if Q.line_hash(x.encode()) not in removed.get(host, ())), host))
    return sorted(map(repr, out))


def test_cleaned_texts_equal_brute_force(spark, monkeypatch):
    licence = prose(5, 60)
    rows = case()
    rows += [(3000 + d, f" Bonjour  été {d}\n\n" + prose(3000 + d, 70) + f"\n{licence}\nbonjour été 7\nend {name(d)}\n", "u") for d in range(40)]
    rows += [(3000, rows[-40][1], "v"), rows[-1], (None, "bonjour été 1\n" + prose(4, 20), "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {
        "s": {Q.line_hash(b"Subscribe to Letter 1 of our house today")},
        "u": {Q.line_hash("bonjour été 1".encode()), Q.line_hash(licence.encode())},
    }
    good = set()
    for d, text, host in rows:
        words = (text or "").split()
        left = [w for x in (text or "").split("\n") if Q.line_hash(x.encode()) not in removed.get(host, ()) for w in x.split()]
        if len(words) >= 10 and d not in (6, 8) and 1000 * len(left) >= 300 * len(words):
            good.add((d, text, host))
    got = Q.clean(docs)
    assert got.schema == docs.schema
    want = slow_clean(rows, removed, good)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == want
    monkeypatch.setattr(Q, "BROADCAST_ROWS", -1)
    assert sorted(map(repr, (tuple(r) for r in Q.clean(docs).collect()))) == want
