from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabgate.llm import packing as P
from tabgate.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, k", [(1, 1), (1, 3), (7, 3), (60, 12), (200, 40)])
def test_differencing_gives_each_piece_a_window(n, k):
    sizes = np.random.default_rng(n).integers(1, 100, n)
    window = P.differencing(sizes, k)
    assert len(window) == n and window.min() >= 0 and window.max() < k
    sums = np.bincount(window, sizes, minlength=k)
    assert sums.max() - sums.min() <= sizes.max()


def test_differencing_of_a_known_case():
    # Two-way: 8 7 6 5 4 -> differences 1 6 5 4 -> 1 1 4 -> 1 3 -> 2.
    sums = np.bincount(P.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4], minlength=2)
    assert sorted(sums) == [14, 16]


def windows_of(sizes, capacity):
    fill = defaultdict(list)
    for w, i, a, n in zip(*(c.tolist() for c in P.pack_group(sizes, capacity))):
        fill[w].append((i, a, a + n))
    return [fill[w] for w in range(max(fill) + 1)]


def whole(fill, sizes):
    parts = defaultdict(list)
    for w in fill:
        for i, a, b in w:
            parts[i].append((a, b))
    for i, size in enumerate(sizes.tolist()):
        edges = sorted(parts[i])
        assert edges[0][0] == 0 and edges[-1][1] == size and all(x[1] == y[0] for x, y in zip(edges, edges[1:]))


def test_cut_rests():
    rest, start, length = P.cut(np.array([5, 1, 4, 9]), 4)
    assert rest.tolist() == [0, 0, 1, 2, 3, 3, 3]
    assert start.tolist() == [0, 4, 0, 0, 0, 4, 8] and length.tolist() == [4, 1, 1, 4, 4, 4, 1]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("capacity", [5, 100, 1024])
def test_groups_are_whole_and_near_equal(seed, capacity):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 300)))
    fill = windows_of(sizes, capacity)
    sums = [sum(b - a for _, a, b in w) for w in fill]
    assert max(sums) <= capacity and max(sums) - min(sums) <= max(capacity // 8, 1)
    assert len(fill) >= -(-int(sizes.sum()) // capacity)
    whole(fill, sizes)


def test_windows_are_those_of_differencing_and_rise_in_number():
    """The sums are those of differencing alone, for the first number of windows that it keeps within the capacity."""
    rng = np.random.default_rng(7)
    rose = 0
    for n in (40, 80, 160, 320):
        sizes = rng.integers(1, 1024, n)
        fill = windows_of(sizes, 1024)
        _, _, length = P.cut(sizes, 128)
        tops = {k: np.bincount(P.differencing(length, k), length, minlength=k) for k in range(-(-int(sizes.sum()) // 1024), len(fill) + 1)}
        assert all(s.max() > 1024 for k, s in tops.items() if k < len(fill))
        assert sorted(sum(b - a for _, a, b in w) for w in fill) == sorted(tops[len(fill)].astype(int).tolist())
        rose += len(fill) > min(tops)
        assert 1024 * len(fill) - sizes.sum() < 3 * 1024
    assert rose


def test_sequences_hold_each_id_once(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 999, int(n))) for n in rng.integers(0, 700, 150)]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(900, None, None, 1), (901, "", "", 2), (902, "a " * 9000, "", 2), (902, "a " * 9000, "", 2), (None, "no id", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(3)
    got = P.pack(docs, PATH).collect()
    tokens = defaultdict(list)
    for d, t, *_ in rows:
        tokens[d].append(encoder(PATH).tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        assert ids == tokens[r.doc_id][0][r.start : r.start + r.length] and r.doc_tokens == len(tokens[r.doc_id][0])
        pieces[r.doc_id].extend(range(r.start, r.start + r.length))
    for d, own in tokens.items():
        assert sorted(pieces[d]) == sorted(i for t in own for i in range(len(t)))
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    sums = []
    for own in windows.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        sums.append(sum(n for _, n in own))
    assert max(sums) <= 1024 and 1024 * len(sums) - sum(sums) < 3 * 1024


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_digest_column(spark):
    import zlib

    row = P.pack(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), PATH).withColumn("c", F.crc32("ids")).first()
    assert row.c == zlib.crc32(bytes(row.ids))
