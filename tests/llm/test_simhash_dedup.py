from __future__ import annotations

import numpy as np
import pytest
import xxhash

from tabgate.llm import simhash_dedup as S


def slow_fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        value |= (2 * ones > len(shingles)) << bit
    return value


def slow_classes(rows: list[tuple], radius: int = 4) -> tuple:
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least: dict[int, int] = {}
    for (d, _), c in zip(rows, label):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return {c: v for c, v in least.items()}, label, fps


def words(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["w%d" % x for x in rng.integers(0, 5000, n)]


def rows_for_test() -> list[tuple]:
    rows: list[tuple] = [(90, None), (91, ""), (92, " \n\t"), (93, "one"), (94, "One"), (95, "a b c d"), (96, "É é É é")]
    for group in range(12):
        base = words(group, 150 + 40 * group)
        for copy in range(group % 4 + 1):
            own = list(base)
            if copy:
                own[copy * 17] = "changed"
            rows.append((group * 10 + copy + 100, " ".join(own)))
    rows += [(7, rows[8][1]), (7, rows[8][1]), (300, "x " * 30000)]
    return rows


def test_classes_equal_brute_force(spark):
    rows = rows_for_test()
    docs = spark.createDataFrame([(d, t, "fp") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect())
    least, label, fps = slow_classes(rows)
    assert got == sorted((d, f"{fps[i]:016x}", least[label[i]]) for i, (d, _) in enumerate(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []
    assert S.keep_one(docs).collect() == []


@pytest.mark.parametrize("radius, k", [(4, 5), (4, 7), (6, 8)])
def test_buckets_hold_all_pairs_in_the_radius(radius, k):
    rng = np.random.default_rng(1)
    masks = S._masks(k, radius)
    for _ in range(200):
        x = int(rng.integers(0, 2**63))
        y = x
        for bit in rng.choice(64, radius, replace=False):
            y ^= 1 << int(bit)
        assert any((x & m) == (y & m) for m in masks)


def test_near_pairs_equal_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 5, 3), dtype=np.uint64)
    fps = np.concatenate([base, (base[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel()])
    buckets = rng.integers(0, 3, len(fps))
    got = {tuple(sorted(p)) for a, b in S.near_pairs(fps, buckets, 4) for p in zip(a.tolist(), b.tolist())}
    want = {
        (i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
        if buckets[i] == buckets[j] and int(fps[i] ^ fps[j]).bit_count() <= 4
    }
    assert got == want


def slow_keep(rows: list[tuple], least: float = 0.8) -> list:
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = []
    for d, t in sorted(rows):
        own = shingles(t)
        if all((len(own & x) / len(own | x) if own | x else 1.0) < least for _, x in kept):
            kept.append((d, own))
    return [d for d, _ in kept]


def test_keep_one_keeps_the_first_of_each_group(spark):
    rows = [(d, t) for d, t in rows_for_test() if d not in (7,)]
    docs = spark.createDataFrame([(d, t, "a", d) for d, t in rows], "doc_id long, text string, _key string, node long")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == slow_keep(rows)


def test_large_class_is_reduced_by_its_first_document(spark):
    base = words(99, 200)
    rows = []
    for d in range(700):
        own = list(base)
        own[d % 200] = f"c{d}"
        rows.append((d, " ".join(own)))
    far = list(base)
    far[::9] = ["z"] * len(far[::9])
    rows.append((1000, " ".join(far)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == slow_keep(rows)


def test_rows_without_id_join_what_they_link(spark, monkeypatch):
    chain = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": 1 << 40 | 0x7F << 50}
    printed = spark.createDataFrame([(5, 1, 0), (None, 2, 0b1111), (9, 3, 0b11111111), (None, 4, chain["d"])], "doc_id long, _key long, fp long")
    got = {r.fp: r.component_id for r in S.classes(printed, 4).collect()}
    assert got == {chain["a"]: 5, chain["b"]: 5, chain["c"]: 5, chain["d"]: None}


def edited(base: list[str], how: str, n: int) -> list[str]:
    if how == "added":
        return base + [f"{how}{i}" for i in range(n)]
    if how == "cut":
        return base[n:]
    if how == "front":
        return [f"{how}{i}" for i in range(n)] + base
    return base[: len(base) // 2] + [f"{how}{i}" for i in range(n)] + base[len(base) // 2 + n :]


def test_keep_one_finds_added_cut_and_short_copies(spark):
    rows, size = [], 0
    for group, size in enumerate([15, 20, 25, 30, 40, 50, 80, 120, 200, 300, 400, 600] * 4):
        base = words(1000 + group, size)
        rows.append((group * 100, " ".join(base)))
        for i, how in enumerate(("added", "cut", "front", "changed")):
            for j, share in enumerate((0.04, 0.12, 0.18)):
                rows.append((group * 100 + 1 + 10 * i + j, " ".join(edited(base, how, max(1, int(share * size))))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == slow_keep(rows)


def test_one_row_of_repeated_rows_and_of_rows_without_id(spark):
    text, other, near = " ".join(words(1, 100)), " ".join(words(2, 100)), " ".join(words(3, 200))
    rows = [(1, text, "a"), (1, text, "b"), (None, text, "c"), (None, other, "d"), (None, other, "e"), (None, near + " end", "f"), (8, near, "g"),
            (None, None, "h"), (None, None, "i"), (3, "", "j")]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _own string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, text), (0, other), (8, near), (3, "")])


def test_kept_sets_equal_all_pairs():
    rng = np.random.default_rng(5)
    kept, slow = S.Kept(0.8), []
    for i in range(400):
        own = np.unique(rng.choice(np.arange(60 if i % 2 else 25, dtype=np.uint64), rng.integers(0, 40)))
        alone = all(S.similarity(own, x) < 0.8 for x in slow)
        slow += [own] * alone
        assert kept.takes(own) == alone
