from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tabgate.llm import suffix_dedup as S


def slow(rows: list[tuple], length: int) -> list[tuple]:
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_is_sorted(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + 1 + seed, 700).astype(np.uint8)
    text[300:450] = text[100:250]
    text[500:650] = 98
    order = S.suffix_array(text, 700)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("seed", range(4))
def test_windows_of_equal_bytes_are_neighbours(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 99 + seed, 900).astype(np.uint8)
    text[600:860] = text[:260]
    text[300:520] = 99
    window = np.arange(len(text)) <= len(text) - 200
    raw = text.tobytes()
    seen = Counter(raw[i : i + 200] for i in range(701))
    want = [bool(window[i]) and seen[raw[i : i + 200]] > 1 for i in range(len(raw))]
    assert S.repeated_windows(text, window, 200).tolist() == want


def test_segments_hold_each_window_once_under_equal_anchors():
    rng = np.random.default_rng(5)
    shared = rng.integers(97, 110, 400).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 110, 90).astype(np.uint8), shared]), np.concatenate([shared, shared[:50]]), shared[:100]]
    offsets = np.cumsum([0, *map(len, texts)])
    s = S.segments(np.concatenate(texts), offsets, 200)
    windows = [(t, a + i) for t, a, n in zip(s["text"].tolist(), s["start"].tolist(), s["n_windows"].tolist()) for i in range(n)]
    assert sorted(windows) == [(t, i) for t in range(2) for i in range(len(texts[t]) - 199)]
    anchor = {}
    for t, a, n, k in zip(*[s[c].tolist() for c in ("text", "start", "n_windows", "anchor")]):
        for i in range(n):
            anchor[texts[t][a + i : a + i + 200].tobytes()] = anchor.get(texts[t][a + i : a + i + 200].tobytes(), set()) | {k}
    assert all(len(k) == 1 for k in anchor.values())


def rows_for_test() -> list[tuple]:
    rng = np.random.default_rng(3)
    make = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    passage = make(260)
    rows: list[tuple] = [(1, None), (2, ""), (3, "a" * 150), (4, "a" * 450), (5, "ab" * 300)]
    for d in range(10, 40):
        rows.append((d, make(int(rng.integers(0, 300))) + passage[: 150 + 5 * d] + make(int(rng.integers(0, 300)))))
    rows += [(50, rows[9][1]), (50, rows[9][1]), (None, rows[12][1]), (51, make(3000)), (52, make(100) + passage + make(70) + passage)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_digests_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_SEGMENTS", hot)
    rows = rows_for_test()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in S.repeat_digests(docs).collect()), key=repr)
    assert got == slow(rows, 200)


def test_texts_are_cut_and_columns_kept(spark):
    rows = [(1, "x" + "pq" * 150, "en", 5), (2, None, "de", 6), (3, "kept", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = S.without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", "en", 5), (2, None, "de", 6), (3, "kept", None, 7)]


def test_empty_table(spark):
    assert S.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
