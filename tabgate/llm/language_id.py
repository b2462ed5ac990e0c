"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are lower-cased and read as UTF-8 bytes in pieces of PIECE bytes. A forward and a backward gated recurrent unit
run over each piece; at every position their two states give probabilities of the languages, and a document's score is
the mean over all its positions. Training, in numpy by back-propagation through time, labels every position of sample
pieces with its document's language.

The sample is bounded: of each language PER_LANGUAGE documents (the first by a hash of their id), and of each
SAMPLE_PIECES pieces spread over its text. Prediction covers whole texts of all documents.

Defined results: a text that is null or has no letter is `und` with score 0, and so is any text if nothing was learned;
repeated rows are predicted each; columns other than the text are no input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import text_blocks
from tabgate.llm.tables import bounded_batches

PIECE = 96
HIDDEN = 16
PER_LANGUAGE = 400
SAMPLE_PIECES = 8
STEPS = 260
BATCH = 192
#: Pieces that are run through the network at a time.
PIECES_AT_ONCE = 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def start_weights(n_languages: int, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    near = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    return {
        **{f"in_{d}": near(256, 3 * hidden, by=0.3) for d in "fb"},
        **{f"state_{d}": near(hidden, 3 * hidden, by=hidden**-0.5) for d in "fb"},
        "out": near(2 * hidden, n_languages, by=0.3), "bias": np.zeros(n_languages, np.float32),
    }


def states(x: np.ndarray, real: np.ndarray, table: np.ndarray, u: np.ndarray, order: range, traced: bool) -> tuple[np.ndarray, list]:
    """Hidden states at all positions of pieces x (pieces x positions); they rest where `real` is 0.

    h' = (1 - z) c + z h with z, r = sigmoid(table[x] + h u) and c = tanh(table[x] + r (h u)).
    """
    hidden = u.shape[0]
    h = np.zeros((len(x), hidden), np.float32)
    out = np.empty((x.shape[1], len(x), hidden), np.float32)
    trace = []
    for t in order:
        a = table[x[:, t]]
        g = h @ u
        zr = sigmoid(a[:, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        c = np.tanh(a[:, 2 * hidden :] + r * g[:, 2 * hidden :])
        new = c + z * (h - c)
        new *= real[:, t, None]
        if traced:
            trace.append((t, h, z, r, c, g[:, 2 * hidden :]))
        out[t] = h = new
    return out, trace


def _back(x: np.ndarray, real: np.ndarray, grad: np.ndarray, trace: list, u: np.ndarray, table_shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the state weights from those of all states, last step first."""
    hidden = u.shape[0]
    d_table, d_u = np.zeros(table_shape, np.float32), np.zeros_like(u)
    d_h = np.zeros((len(x), hidden), np.float32)
    for t, h, z, r, c, gc in reversed(trace):
        d = (d_h + grad[t]) * real[:, t, None]
        d_c = d * (1 - z) * (1 - c * c)
        d_z = d * (h - c) * z * (1 - z)
        d_r = d_c * gc * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_c], axis=1)
        d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
        np.add.at(d_table, x[:, t], d_a)
        d_u += h.T @ d_g
        d_h = d * z + d_g @ u.T
    return d_table, d_u


def probabilities(f: np.ndarray, b: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    hidden = f.shape[-1]
    y = f @ w["out"][:hidden] + b @ w["out"][hidden:] + w["bias"]
    y = np.exp(y - y.max(axis=-1, keepdims=True))
    return y / y.sum(axis=-1, keepdims=True)


def loss_and_gradients(w: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all real positions."""
    f, trace_f = states(x, real, w["in_f"], w["state_f"], range(x.shape[1]), True)
    b, trace_b = states(x, real, w["in_b"], w["state_b"], range(x.shape[1] - 1, -1, -1), True)
    p = probabilities(f, b, w)
    weight = (real.T / real.sum())[:, :, None].astype(np.float32)
    rows = np.arange(len(x))
    loss = -float((np.log(p[:, rows, label] + 1e-9) * weight[:, :, 0]).sum())
    p[:, rows, label] -= 1
    d = p * weight
    hidden = f.shape[-1]
    grads = {
        "out": np.concatenate([np.einsum("tnh,tnc->hc", s, d, optimize=True) for s in (f, b)]), "bias": d.sum(axis=(0, 1)),
    }
    grads["in_f"], grads["state_f"] = _back(x, real, d @ w["out"][:hidden].T, trace_f, w["state_f"], w["in_f"].shape)
    grads["in_b"], grads["state_b"] = _back(x, real, d @ w["out"][hidden:].T, trace_b, w["state_b"], w["in_b"].shape)
    return loss, grads


def as_pieces(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of at most PIECE bytes as rows, and which places are real."""
    x = np.zeros((len(data), PIECE), np.uint8)
    real = np.zeros((len(data), PIECE), np.float32)
    for i, d in enumerate(data):
        x[i, : len(d)] = np.frombuffer(d, np.uint8)
        real[i, : len(d)] = 1
    return x, real


@dataclass(frozen=True)
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    def pooled(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of each text; zeros for an empty one."""
        w, sizes = self.weights, np.diff(offsets)
        per_text = -(-sizes // PIECE)
        text_of = np.repeat(np.arange(len(sizes)), per_text)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        starts = offsets[text_of] + nth * PIECE
        lengths = np.minimum(PIECE, offsets[text_of + 1] - starts)
        total = np.zeros((len(sizes), len(self.languages)))
        padded = np.concatenate([buf, np.zeros(PIECE, np.uint8)])
        place = np.arange(PIECE)
        for at in range(0, len(starts), PIECES_AT_ONCE):
            some = slice(at, at + PIECES_AT_ONCE)
            real = (place[:, None] < lengths[some]).astype(np.float32)
            np.add.at(total, text_of[some], _summed(padded[starts[some] + place[:, None]], real, w).T)
        return total / np.maximum(sizes, 1)[:, None]


class _Cell:
    """A recurrent unit over many pieces at once, features by pieces, with its buffers: what `states` does, faster."""

    def __init__(self, table: np.ndarray, u: np.ndarray, n: int) -> None:
        self.hidden = u.shape[0]
        half = np.repeat(np.float32([0.5, 1]), [2 * self.hidden, self.hidden])  # sigmoid(x) is 0.5 + 0.5 tanh(x / 2)
        self.table, self.u = np.ascontiguousarray((table * half).T), np.ascontiguousarray((u * half).T)
        self.a, self.g = (np.empty((3 * self.hidden, n), np.float32) for _ in range(2))
        self.h = np.zeros((self.hidden, n), np.float32)

    def step(self, x: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        k, a, g, h = self.hidden, self.a, self.g, self.h
        np.take(self.table, x, axis=1, out=a, mode="clip")
        np.matmul(self.u, h, out=g)
        zr, c = a[: 2 * k], a[2 * k :]
        zr += g[: 2 * k]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        g[2 * k :] *= zr[k:]
        c += g[2 * k :]
        np.tanh(c, out=c)
        h -= c
        h *= zr[:k]
        h += c
        if real is not None:
            h *= real
        return h


def _summed(x: np.ndarray, real: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """For pieces x (positions by pieces) the sums over real positions of each language's probability."""
    n_places, n = x.shape
    whole = real.all(axis=1)
    hidden = w["state_f"].shape[0]
    forward = np.empty((n_places, hidden, n), np.float32)
    cell = _Cell(w["in_f"], w["state_f"], n)
    for t in range(n_places):
        forward[t] = cell.step(x[t], None if whole[t] else real[t])
    cell = _Cell(w["in_b"], w["state_b"], n)
    out_f, out_b = np.ascontiguousarray(w["out"][:hidden].T), np.ascontiguousarray(w["out"][hidden:].T)
    total = np.zeros((len(out_f), n), np.float32)
    for t in range(n_places - 1, -1, -1):
        y = out_f @ forward[t] + out_b @ cell.step(x[t], None if whole[t] else real[t]) + w["bias"][:, None]
        y -= y.max(axis=0)
        np.exp(y, out=y)
        y *= real[t] / y.sum(axis=0)
        total += y
    return total


def fit(samples: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network:
    """From (language, text) pairs; each batch draws languages evenly."""
    languages = sorted({lang for lang, _ in samples})
    if not samples:
        return Network([], {})
    encoded = [(languages.index(lang), text.lower().encode()[:PIECE]) for lang, text in samples]
    x, real = as_pieces([d for _, d in encoded])
    label = np.array([i for i, _ in encoded])
    full = real.any(axis=1)
    x, real, label = x[full], real[full], label[full]
    own = [np.flatnonzero(label == i) for i in range(len(languages))]
    own = [o for o in own if len(o)]
    w = start_weights(len(languages), hidden, seed)
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1 if own else 1):
        some = np.concatenate([rng.choice(o, BATCH // len(own) + 1) for o in own])
        _, grads = loss_and_gradients(w, x[some], real[some], label[some])
        rate = 0.02 * (1 - step / (steps + 1))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(languages, w)


def rank_limit(n: int, wanted: int) -> int:
    """Of n 64-bit hashes about `wanted` lie up to this one (all of fewer)."""
    return (1 << 63) - 1 if n <= wanted else -(1 << 63) + (wanted << 64) // n


def sample_pieces(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, str]]:
    """At most PER_LANGUAGE * SAMPLE_PIECES short pieces of each language, for the driver."""
    own = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # One row for each language. Ranks above what holds four times the sample are left out before the rows are ranked,
    # so that not every task sends its own first ones.
    counts = own.groupBy(F.col(lang).cast("string").alias("lang")).count().collect()
    if not counts:
        return []
    enough = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, rank_limit(r["count"], 4 * PER_LANGUAGE))])
    own = own.filter(F.xxhash64(F.col(doc_id)) <= enough[F.col(lang).cast("string")])
    first = Window.partitionBy("lang").orderBy("_rank", "_key")
    chosen = (
        own.select(
            F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id)).alias("_rank"), F.xxhash64(text).alias("_key"),
            F.transform(
                F.sequence(F.lit(0), F.lit(SAMPLE_PIECES - 1)),
                lambda i: F.substr(
                    F.col(text),
                    (F.lit(1) + F.floor(i * F.greatest(F.length(text) - PIECE, F.lit(0)) / F.lit(SAMPLE_PIECES - 1))).cast("int"),
                    F.lit(PIECE),
                ),
            ).alias("pieces"),
        )
        .withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= PER_LANGUAGE)
    )
    rows = chosen.select("lang", "_nth", F.array_distinct("pieces").alias("pieces")).collect()
    return [(r.lang, p) for r in sorted(rows, key=lambda r: (r.lang, r._nth)) for p in r.pieces]


def _predict_rows(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters = pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False)
        lowered = pa.RecordBatch.from_arrays(
            [batch["_row"], pc.utf8_lower(pc.fill_null(batch["text"], "")), letters], ["_row", "text", "letters"]
        )
        for block in text_blocks(lowered, "text"):
            known = block.batch["letters"].to_numpy(zero_copy_only=False) & bool(net.languages)
            if net.languages:
                p = net.pooled(block.buf, block.offsets)
                best = p.argmax(axis=1)
                names = [net.languages[i] if k else "und" for i, k in zip(best.tolist(), known.tolist())]
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            else:
                names, score = ["und"] * len(block), np.zeros(len(block))
            yield pa.RecordBatch.from_arrays([block.batch["_row"], pa.array(names, pa.string()), pa.array(score)], ["_row", "lang_pred", "score"])


def predict(docs: DataFrame, net: Network, carried: list[Column], text: str = "text") -> DataFrame:
    """The carried columns of each row, lang_pred and score. The network goes to the executors: some 100 kB."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*carried).alias("_row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    shape = f"_row {dict(rows.dtypes)['_row']}, lang_pred string, score double"
    return rows.mapInArrow(lambda batches: _predict_rows(batches, shared.value), shape).select("_row.*", "lang_pred", "score")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null without id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from two of three folds of labelled rows, predicted for all."""
    held_out = F.coalesce(fold(doc_id, 3) == 1, F.lit(False))
    net = fit(sample_pieces(docs.filter(fold(doc_id, 3) != 1), text, lang, doc_id))
    return predict(docs, net, [F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out")], text)
