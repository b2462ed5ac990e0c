from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from tabgate.llm import quality_model as Q
from tabgate.llm.arrow_text import text_blocks


def some_features(texts: list) -> Q.Features:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    (block,) = text_blocks(batch, "text")
    return Q.features(block, np.arange(len(texts), dtype=float)[:, None])


def test_scores_equal_the_sum_over_pairs():
    f = some_features(["one two two three", "", "Four five ### one", None])
    m = Q.untrained(len(Q.STATISTICS) + 1, 5)
    m.w = np.random.default_rng(1).normal(0, 1, len(m.w))
    m.v *= 40
    first = 1 << Q.WORD_BITS
    raw, _ = m.raw(f)
    for i in range(4):
        x = np.zeros(len(m.w))
        own = f.row == i
        x[f.bucket[own]] = f.value[own]
        x[first:] = m._numbers(f.numbers)[i]
        at = np.flatnonzero(x)
        pairs = sum(m.v[a] @ m.v[b] * x[a] * x[b] for n, a in enumerate(at) for b in at[:n])
        assert abs(raw[i] - (m.bias + m.w @ x + pairs)) < 1e-9


def test_gradients_equal_finite_differences():
    f = some_features(["one two two three", "", "Four five ### one", "six"])
    m = Q.untrained(len(Q.STATISTICS) + 1, 5)
    m.v *= 20
    label = np.array([0.0, 1, 1, 0])
    d_b, d_w, d_v = Q.gradients(m, f, label)

    def loss() -> float:
        p = m.scores(f)
        return -float(np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)))

    for a, d in ((m.w, d_w), (m.v.reshape(-1), d_v.reshape(-1))):
        for i in np.argsort(-np.abs(d))[:6].tolist():
            old, ends = a[i], []
            for step in (1e-5, -1e-5):
                a[i] = old + step
                ends.append(loss())
            a[i] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - d[i]) < 1e-5


def rows_and_labels() -> tuple[list, list]:
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 300, int(rng.integers(20, 90)))]
        good = int(rng.random() < 0.7)
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), "en", 0.1, 5))
        labels.append((i, good, 0))
    rows += [(900, None, "en", 0.1, None), (901, "", None, 0.1, -4), (None, "no id ###", "en", 0.1, 1), (5, rows[5][1], "en", 0.1, 5), (902, "w1 " * 60000, "en", 0.1, 2)]
    labels += [(5, labels[5][1], 0), (None, 1, 0), (7777, 1, 0), (900, None, 0)]
    return rows, labels


def test_held_out_accuracy_and_defined_results(spark):
    rows, labels = rows_and_labels()
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score double, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs, marks).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.97 * len(held) > 0


def test_no_labels_and_empty_tables(spark):
    rows, labels = rows_and_labels()
    docs = spark.createDataFrame(rows[:5], "doc_id long, text string, quality string, score double, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.quality_scores(docs, marks.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), marks).collect() == []


def test_an_id_of_many_rows_is_one_row_of_the_sample(spark):
    rows = [(5, f"text {i % 300} of a hot id", i) for i in range(3000)] + [(6, "another text", 1), (None, "no id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(7)
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (8, 1)], "doc_id long, quality int")
    features, y = Q.training_rows(docs, labels, "text", "doc_id", "quality", ("n_chars",))
    assert sorted(y) == [0, 1] and len(features.numbers) == 2
    again, _ = Q.training_rows(docs.repartition(3), labels, "text", "doc_id", "quality", ("n_chars",))
    assert np.array_equal(features.numbers, again.numbers) and np.array_equal(features.bucket, again.bucket)
