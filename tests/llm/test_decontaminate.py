from __future__ import annotations

from collections import Counter

import numpy as np

from tabgate.llm import decontaminate as D


def shingles(words: list[str]) -> Counter:
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow(docs: list[tuple], items: list[tuple], least: float = 0.8) -> dict[tuple, float]:
    best = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            own = (item or "").lower().split()
            if not own or not words or (len(own) < 5 and len(words) < len(own)):
                continue
            n = min(len(own), len(words))
            for at in range(len(words) - n + 1):
                a, b = shingles(words[at : at + n]), shingles(own)
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= least:
                    best[(d, i)] = max(s, best.get((d, i), 0))
    return best


def case() -> tuple[list[tuple], list[tuple]]:
    rng = np.random.default_rng(4)
    make = lambda n: [f"w{x}" for x in rng.integers(0, 900, n)]
    items = [(i, " ".join(make(int(rng.integers(12, 70))))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "only three words"), (103, items[3][1]), (104, "la " * 30)]
    docs: list[tuple] = [(0, None), (1, ""), (2, "x"), (3, "Only THREE words here")]
    for d in range(10, 60):
        own = items[d % 25][1].split()
        for _ in range(d % 4):
            own[int(rng.integers(0, len(own)))] = "new"
        docs.append((d, " ".join(make(d) + own + make(40))))
    docs += [(70, items[5][1]), (70, items[5][1]), (71, " ".join(items[6][1].split()[:-1])), (72, " ".join(make(5000))), (73, "la " * 300)]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = case()
    got = D.leaks(
        spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, item_id long"),
        spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long"),
    ).collect()
    best = slow(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in best.items()}
    assert len(got) == len(best) + 1  # document 70 is there twice


def test_within_radius_equals_brute_force():
    rng = np.random.default_rng(5)
    items = D.Items([(i, " ".join(f"w{x}" for x in rng.integers(0, 99, 30))) for i in range(60)])
    prints = np.concatenate([items.prints ^ np.uint64(0xFFFFF), rng.integers(0, 2**63, 60, dtype=np.uint64)])
    at, item = items.within_radius(prints)
    want = {(a, b) for a in range(len(prints)) for b in range(60) if int(prints[a] ^ items.prints[b]).bit_count() <= D.RADIUS}
    assert set(zip(at.tolist(), item.tolist())) == want


def test_items_in_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = case()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = D.leaks(table, bench).count()
    monkeypatch.setattr(D, "ITEM_BLOCK", 7)
    assert D.leaks(table, bench).count() == whole
    assert D.leaks(table.limit(0), bench).collect() == [] == D.leaks(table, bench.limit(0)).collect()
    left = D.without_leaks(table, bench)
    held = {d for d, _ in slow(docs, items)}
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in held)
