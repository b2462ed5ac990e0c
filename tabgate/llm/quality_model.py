"""Quality scores by a factorisation machine over hashed words, statistics of a text's structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j). With K factors a feature, the sum over
pairs is half of sum over factors of (sum v_if x_i)^2 - sum v_if^2 x_i^2: linear in the features present.

Features: 2**WORD_BITS buckets of words in lower case (counts, scaled to length 1), the statistics named in STATISTICS
and numeric columns of the row (log1p; null: 0), both standardised. Learned from at most SAMPLE labelled rows, the
first by a hash of their id, of an id with several texts one; scores cover whole texts of all documents.

Defined results: null and empty texts have no words and are scored like any other; a row without label is not learned
from; without any label, or with one value of it only, the machine is untrained and scores 0.5; repeated rows are
scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import TextBlock, text_blocks
from tabgate.llm.language_id import fold, rank_limit
from tabgate.llm.quality_rules import SYMBOLS, repeated_words
from tabgate.llm.tables import bounded_batches

WORD_BITS = 13
FACTORS = 6
SAMPLE = 6_000
EPOCHS = 12
BATCH = 128

STATISTICS = (
    "log_words", "log_bytes", "mean_word_bytes", "symbols_per_word", "upper_share", "digit_share", "mark_share",
    "repeated_share", "distinct_share", "lines_per_word", "short_share", "non_ascii_share",
)
UPPER, LETTER, DIGIT, MARK, NEWLINE, BEYOND = (np.zeros(256, bool) for _ in range(6))
UPPER[ord("A") : ord("Z") + 1] = True
LETTER[ord("a") : ord("z") + 1] = True
LETTER |= UPPER
DIGIT[ord("0") : ord("9") + 1] = True
MARK[33:127] = ~(LETTER | DIGIT)[33:127]
NEWLINE[10] = True
BEYOND[128:] = True


@dataclass
class Features:
    """Rows of sparse word features (row, bucket, value), and of numbers."""

    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    numbers: np.ndarray


def features(block: TextBlock, metadata: np.ndarray) -> Features:
    n, n_words = len(block), block.n_words
    buckets = (block.word_hashes(lower=True) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    cells, counts = np.unique(block.text_of_word * (1 << WORD_BITS) + buckets, return_counts=True)
    row, bucket = cells >> WORD_BITS, cells & ((1 << WORD_BITS) - 1)
    value = counts / np.sqrt(np.bincount(row, counts.astype(float) ** 2, minlength=n))[row]
    sizes, words = np.diff(block.offsets), np.maximum(n_words, 1)
    of = {k: block.counts(t[block.buf]) for k, t in dict(u=UPPER, a=LETTER, d=DIGIT, m=MARK, n=NEWLINE, b=BEYOND, s=SYMBOLS).items()}
    short = np.bincount(block.text_of_word, (block.ends - block.starts) <= 2, minlength=n)
    inside = np.bincount(block.text_of_word, block.ends - block.starts, minlength=n)
    hashes = np.unique(block.text_of_word * np.uint64(0x9E3779B97F4A7C15) + block.word_hashes(lower=True), return_index=True)[1]
    distinct = np.bincount(block.text_of_word[hashes], minlength=n)
    size = np.maximum(sizes, 1)
    numbers = np.column_stack([
        np.log1p(n_words), np.log1p(sizes), inside / words, of["s"] / words, of["u"] / np.maximum(of["a"], 1), of["d"] / size,
        of["m"] / size, repeated_words(block) / words, distinct / words, of["n"] / words, short / words, of["b"] / size,
    ])
    return Features(row, bucket, value, np.column_stack([numbers, metadata]))


@dataclass
class Machine:
    """w and v: weights and factors of the word buckets, then of the numbers; standard: mean and spread of these."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    standard: tuple[np.ndarray, np.ndarray]

    def _numbers(self, x: np.ndarray) -> np.ndarray:
        mean, spread = self.standard
        return np.clip((x - mean) / spread, -5, 5)

    def raw(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of factors."""
        n, first = len(f.numbers), 1 << WORD_BITS
        numbers = self._numbers(f.numbers)
        linear = np.bincount(f.row, self.w[f.bucket] * f.value, minlength=n) + numbers @ self.w[first:]
        sums, squares = numbers @ self.v[first:], numbers**2 @ self.v[first:] ** 2
        for k in range(self.v.shape[1]):
            vx = self.v[f.bucket, k] * f.value
            sums[:, k] += np.bincount(f.row, vx, minlength=n)
            squares[:, k] += np.bincount(f.row, vx * vx, minlength=n)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def scores(self, f: Features) -> np.ndarray:
        return 0.5 + 0.5 * np.tanh(0.5 * self.raw(f)[0])


def untrained(n_numbers: int, seed: int = 3) -> Machine:
    n = (1 << WORD_BITS) + n_numbers
    v = np.random.default_rng(seed).normal(0, 0.01, (n, FACTORS))
    return Machine(0.0, np.zeros(n), v, (np.zeros(n_numbers), np.ones(n_numbers)))


def gradients(m: Machine, f: Features, label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean log loss by bias, w and v."""
    n, first = len(label), 1 << WORD_BITS
    raw, sums = m.raw(f)
    error = (0.5 + 0.5 * np.tanh(0.5 * raw) - label) / n
    numbers = m._numbers(f.numbers)
    e = error[f.row] * f.value
    d_w = np.concatenate([np.bincount(f.bucket, e, minlength=first), numbers.T @ error])
    d_v = np.empty_like(m.v)
    for k in range(m.v.shape[1]):
        own = e * (sums[f.row, k] - m.v[f.bucket, k] * f.value)
        d_v[:first, k] = np.bincount(f.bucket, own, minlength=first)
        d_v[first:, k] = numbers.T @ (error * sums[:, k]) - (numbers**2).T @ error * m.v[first:, k]
    return float(error.sum()), d_w, d_v


def _some(f: Features, edges: np.ndarray, rows: np.ndarray) -> Features:
    n = edges[rows + 1] - edges[rows]
    at = np.repeat(edges[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return Features(np.repeat(np.arange(len(rows)), n), f.bucket[at], f.value[at], f.numbers[rows])


def fit(f: Features, label: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Machine:
    m = untrained(f.numbers.shape[1], seed)
    if len(np.unique(label)) < 2:
        m.v[:] = 0
        return m
    m.standard = (f.numbers.mean(axis=0), np.maximum(f.numbers.std(axis=0), 1e-6))
    rng = np.random.default_rng(seed)
    edges = np.searchsorted(f.row, np.arange(len(label) + 1))
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    squares = [1e-8, np.full_like(m.w, 1e-8), np.full_like(m.v, 1e-8)]
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            d_b, d_w, d_v = gradients(m, _some(f, edges, rows), label[rows])
            d_w += 1e-5 * m.w
            d_v += 1e-5 * m.v
            for square, d in zip(squares[1:], (d_w, d_v)):
                square += d * d
            squares[0] += d_b * d_b
            m.bias -= 0.1 * d_b / squares[0] ** 0.5
            m.w -= 0.1 * d_w / np.sqrt(squares[1])
            m.v -= 0.05 * d_v / np.sqrt(squares[2])
    return m


def _metadata(block: TextBlock, n: int) -> np.ndarray:
    columns = [block.batch[f"_m{i}"].to_numpy(zero_copy_only=False) for i in range(n)]
    return np.column_stack([np.log1p(np.maximum(c, 0)) for c in columns]) if columns else np.zeros((len(block), 0))


def _inputs(docs: DataFrame, text: str, numbers: tuple[str, ...], carried: list[Column]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    meta = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_m{i}") for i, c in enumerate(numbers)]
    return docs.select(F.struct(*carried).alias("_row"), F.col(text).alias("text"), *meta)


def training_rows(
    docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, numbers: tuple[str, ...]
) -> tuple[Features, np.ndarray]:
    """Features and labels of at most SAMPLE labelled rows, made on the executors and gathered on the driver."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("_labelled"), F.col(label).cast("int").alias("_label"))
    known = known.distinct()
    # Ranks above what holds four times the sample are left out before the rows are ranked.
    known = known.filter(F.xxhash64("_labelled") <= rank_limit(known.count(), 4 * SAMPLE))
    chosen = known.orderBy(F.xxhash64("_labelled"), "_labelled", "_label").limit(SAMPLE)
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("_labelled"))  # SAMPLE rows of two numbers
    # Of an id with several rows the text of least hash is learned from, so at most SAMPLE rows reach the driver; each
    # task keeps one of its own before rows are shuffled.
    held = F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias(text), *[F.col(c).alias(c) for c in numbers])
    one = rows.groupBy("_labelled", "_label").agg(F.min(held).alias("_held"))
    rows = one.select(F.col("_labelled"), F.col("_label"), *[F.col("_held")[c].alias(c) for c in (text, *numbers)])
    inputs = _inputs(rows, text, numbers, [F.col("_labelled").cast("long").alias("id"), F.col("_label").alias("label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                f = features(block, _metadata(block, len(numbers)))
                edges = np.searchsorted(f.row, np.arange(len(block) + 1)).tolist()
                lists = [
                    [x[a:b].astype(t).tobytes() for a, b in zip(edges, edges[1:])]
                    for x, t in ((f.bucket, "<u2"), (f.value, "<f4"))
                ]
                yield pa.RecordBatch.from_arrays(
                    [block.batch["_row"].field(0), block.batch["_row"].field(1), *[pa.array(x, pa.binary()) for x in lists],
                     pa.array(f.numbers.tolist(), pa.list_(pa.float64()))],
                    ["id", "label", "bucket", "value", "numbers"],
                )

    got = inputs.mapInArrow(run, "id long, label int, bucket binary, value binary, numbers array<double>").collect()
    got.sort(key=lambda r: (r.id, r.label, bytes(r.bucket), bytes(r.value)))
    width = len(STATISTICS) + len(numbers)
    buckets = [np.frombuffer(bytes(r.bucket), "<u2") for r in got]
    row = np.repeat(np.arange(len(got)), [len(b) for b in buckets]) if got else np.zeros(0, np.int64)
    f = Features(
        row, np.concatenate([np.zeros(0, np.int64), *buckets]).astype(np.int64),
        np.concatenate([np.zeros(0), *[np.frombuffer(bytes(r.value), "<f4") for r in got]]),
        np.array([r.numbers for r in got], float).reshape(-1, width),
    )
    return f, np.array([r.label for r in got], float)


def score(docs: DataFrame, machine: Machine, carried: list[Column], text: str = "text", numbers: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns and the score of each row. The machine goes to the executors: some 500 kB."""
    inputs = _inputs(docs, text, numbers, carried)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                scores = shared.value.scores(features(block, _metadata(block, len(numbers))))
                yield pa.RecordBatch.from_arrays([block.batch["_row"], pa.array(scores)], ["_row", "score"])

    return inputs.mapInArrow(run, f"_row {dict(inputs.dtypes)['_row']}, score double").select("_row.*", "score")


def quality_scores(
    docs: DataFrame, labels: DataFrame, least: float = 0.3, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    numbers: tuple[str, ...] = ("n_chars",),
) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from four of five folds of labelled rows, scored for all."""
    numbers = tuple(c for c in numbers if c in docs.columns)
    held_out = F.coalesce(fold(doc_id, 5) == 0, F.lit(False))
    f, y = training_rows(docs, labels.filter(fold(doc_id, 5) != 0), text, doc_id, label, numbers)
    scored = score(docs, fit(f, y), [F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out")], text, numbers)
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
