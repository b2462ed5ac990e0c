from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tabgate.llm import clusters


def brute(rows, k, rounds, size, scale, salt):
    kept = [
        (v, [math.floor(scale * float(np.float32(c))) for c in x])
        for v, x in rows
        if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x)
    ]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for c in range(len(centroids)):
            members = [x for (_, x), o in zip(kept, own) if o == c]
            if members:
                centroids[c] = [sum(v) // len(members) for v in zip(*members)]
    last = [nearest(x) for _, x in kept]
    total = sum(d for d, _ in last)
    return [
        (v, c, d, sum(e for e, o in last if o == c), total,
         hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (v, _), (d, c) in zip(kept, last)
    ]


def check(spark, rows, k=3, rounds=4, size=4, scale=16, salt="s:"):
    wide = [(v, x, 7, "x") for v, x in rows]
    table = spark.createDataFrame(wide, "vec_id long, embedding array<float>, cluster int, distance string")
    got = clusters.clusters(table, k, rounds, size, scale, salt)
    kinds = dict(got.dtypes)
    assert kinds == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint",
                     "inertia": "bigint", "centroid_sha256": "string"}
    want = brute(rows, k, rounds, size, scale, salt)
    limit = 1 << 63
    want = [(v, c, *(n if n < limit else None for n in (d, i, t)), h) for v, c, d, i, t, h in want]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def some(n, seed, size=4):
    return [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(seed).normal(0, 2, (n, size)).astype(np.float32))]


def test_equals_brute_force(spark):
    check(spark, some(90, 1))
    check(spark, some(60, 2), k=7, rounds=6)


def test_ties_repeats_and_odd_rows(spark):
    grid = [(i, [float(i % 2), float(i // 2 % 2), -1.0, 0.5]) for i in range(24)]
    odd = [
        (100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 3.0, 4.0]), (104, [1.0, math.nan, 3.0, 4.0]),
        (105, [1.0, math.inf, 3.0, 4.0]), (106, [1.0, -math.inf, 3.0, 4.0]), (None, [1.0, 1.0, 1.0, 1.0]),
        (5, [9.0, 9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0, 9.0]), (None, [-3.0, 1.0, 1.0, 1.0]),
    ]
    check(spark, grid + odd, k=4)


def test_few_or_no_vectors(spark):
    check(spark, [(1, [1.0, 2.0, 3.0, 4.0])])
    check(spark, [(1, None)])
    check(spark, [])


def test_beyond_64_bits(spark):
    big = [(i, [float((-1) ** i * 1e7), float(i), 2.0**40, -(2.0**41)]) for i in range(12)]
    check(spark, some(20, 3) + [(100 + i, x) for i, x in big])
    check(spark, some(20, 3) + [(200, [2.0**58, 0.0, 0.0, -(2.0**58)]), (201, [2.0**57, 1.0, 0.0, 1.0])])


@pytest.mark.parametrize("shift", [0.0, 5.0])
def test_search_rejects_and_stays_exact(shift):
    random = np.random.default_rng(4)
    means = random.normal(0, shift, (400, 1))
    x = np.floor(1024 * (random.normal(0, 0.3, (400, 64)) + means)).astype(np.int64)
    centroids = x[:16]
    chosen, distance, tried = clusters.Search(centroids.tolist()).nearest(x)
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (chosen == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    # Vectors that differ in their mean need few distances; those that don't need all of them.
    assert tried < 0.3 * every.size if shift else tried <= every.size
