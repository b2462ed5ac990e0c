from __future__ import annotations

import re
from collections import Counter

from tabgate.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, share=50, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = set()
    for lang, counted in f.items():
        known = {p: a for p, a in counted.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in known.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in known.items()):
                continue
            cut = min((1_000_000 * a * a // (counted[p[:k]] * counted[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-cut[0], -a, " ".join(p).encode(), counted[p[: cut[1]]], counted[p[cut[1] :]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def found(spark, rows, **named):
    docs = spark.createDataFrame(rows, "text string, lang string, phrase int, n int, f string")
    got = phrases.collocations(docs, **named)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ROWS = [
    ("New York is big, new york is OLD\nnew\tyork", "en"),
    (" new  york is.new york!! is big", None),
    (None, "en"), ("", "de"), (" \t ", "de"), (".,;", "fr"),
    ("a a a a a a a a", "fr"),
    ("ÄB äB Äb ÄB äB", "de"),
    ("one\x0btwo one two one\x0ctwo one two", "en"),
    ("x y z w x y z w x y z w", "it"),
    ("new york is big", None), ("new york is big", None),
]


def test_equals_brute_force(spark):
    rows = [(t, la, 1, 2, "q") for t, la in ROWS]
    for least, longest, share, top in ((2, 3, 50, 2000), (2, 4, 90, 3), (3, 2, 50, 2), (1, 3, 1000, 5)):
        want = brute(ROWS, longest, least, share, top)
        assert want
        assert found(spark, rows, least=least, longest=longest, share=share, top=top) == want


def test_hot_parts_are_sent_and_give_the_same(spark, monkeypatch):
    rows = [(" ".join(f"the w{i % 40} of w{i * 7 % 30}" for i in range(j, j + 60)), "en") for j in range(0, 300, 10)]
    want = brute(rows, 3, 2, 50, 500)
    wide = [(t, la, 1, 2, "q") for t, la in rows]
    monkeypatch.setattr(phrases, "HEAVY_SHARE", 10**9)
    monkeypatch.setattr(phrases, "FEWEST_USES", 3)
    monkeypatch.setattr(phrases, "SALTS", 2)
    assert found(spark, wide, least=2, top=500) == want


def test_products_beyond_64_bits(spark):
    shape = "a long, l long, r long"
    numbers = [(10**15, 10**15, 10**15), (3 * 10**12 + 1, 7 * 10**12, 5 * 10**12 + 3), (10, 9_999_999, 12)]
    got = spark.createDataFrame(numbers, shape)
    got = got.select("a", "l", "r", phrases._ratio(got.a, got.l, got.r).alias("score")).collect()
    assert all(r.score == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_without_rows(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, None, None, None, None)]) == set()
