"""Packing documents into windows of tokens by multiway Karmarkar-Karp differencing.

A document is its ids and an end id. Whole windows are cut off a document first; they need no partner. The rests of
documents that fill about GROUP_WINDOWS windows form a group. Its rests are cut into pieces of at most an eighth of the
capacity, as two to five whole rests a window can't be balanced. In a group of k windows each piece starts as a partial
partition with one filled window; the two partitions with the largest imbalance (largest minus smallest sum) are
merged, the largest sums of one with the smallest of the other, until one is left. Windows then differ by a few ids. k
starts at the fewest windows that could do; while a window exceeds the capacity, the group is partitioned anew with one
more. Nothing is moved after differencing; pieces of a rest that follow each other in a window are one piece.

Groups are formed as a task reads its rows, so nothing is shuffled.

Defined results: a null or empty text is its end id; repeated rows are packed each; further columns are not read; an
empty table gives no windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import frees_memory, text_blocks
from tabgate.llm.tables import bounded_batches
from tabgate.llm.tokens import ENCODED_BYTES, encoder

#: The windows of a group; one window more than needed is 0.8 % of padding. A group of 256 takes three times the time.
GROUP_WINDOWS = 128
#: Pieces of rests are at most this part of a window.
PIECES_A_WINDOW = 8
#: Sequence ids: from this on, windows of groups; below, whole windows of single documents.
GROUPED = 1 << 62


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each piece. A partition's sums ascend; a sum and its place are sorted as one integer."""
    n = len(sizes)
    bits = max(int(k - 1).bit_length(), 1)
    places, mask = np.arange(k), (1 << bits) - 1
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums[i] = np.zeros(k, np.int64)
        sums[i][-1] = size
        heap.append((-size if k > 1 else 0, i))
    heapq.heapify(heap)
    merges = []  # (first, second, where each sum came from)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums.pop(a) + sums.pop(b)[::-1]
        merged <<= bits
        merged |= places
        merged.sort(kind="stable")
        new = n + len(merges)
        merges.append((a, b, merged & mask))
        merged >>= bits
        sums[new] = merged
        heapq.heappush(heap, (int(merged[0]) - int(merged[-1]), new))
    place = {n + len(merges) - 1 if merges else 0: np.arange(k)}
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        own = np.empty(k, np.int64)
        own[order] = place.pop(n + at)
        place[a], place[b] = own, own[::-1]
    return np.array([place[i][-1] for i in range(n)], np.int64)


def cut(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rest, the start in it and the length of each piece: pieces of `most` ids, and what is left of each rest."""
    per_rest = -(-sizes // most)
    rest = np.repeat(np.arange(len(sizes)), per_rest)
    start = most * (np.arange(len(rest)) - np.repeat(np.cumsum(per_rest) - per_rest, per_rest))
    return rest, start, np.minimum(sizes[rest] - start, most)


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window, rest, start in the rest and length of each piece, in this order; no window is above the capacity."""
    rest, start, length = cut(sizes, max(capacity // PIECES_A_WINDOW, 1))
    k = max(-(-int(sizes.sum()) // capacity), 1)
    while True:
        window = differencing(length, k)
        if np.bincount(window, length, minlength=k).max() <= capacity:
            break
        k += 1
    order = np.lexsort((start, rest, window))
    window, rest, start, length = window[order], rest[order], start[order], length[order]
    follows = (window[1:] == window[:-1]) & (rest[1:] == rest[:-1]) & (start[1:] == start[:-1] + length[:-1])
    first = np.flatnonzero(np.append(True, ~follows))
    return window[first], rest[first], start[first], np.add.reduceat(length, first)


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


@frees_memory
def _pack_rows(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    sequence, groups = task << 36, 0
    held: list[tuple] = []  # doc_id, start, doc_tokens
    rests: list[np.ndarray] = []  # their ids
    size = 0

    def grouped() -> pa.RecordBatch:
        nonlocal groups
        sizes = np.array([len(r) for r in rests], np.int64)
        window, rest, start, length = pack_group(sizes, capacity)
        first = GROUPED + (task << 36) + (groups << 12)
        groups += 1
        ends = np.cumsum(length)
        begins = ends - length
        opens = np.append(True, window[1:] != window[:-1])
        offset = begins - begins[opens][np.cumsum(opens) - 1]
        source = (np.cumsum(sizes) - sizes)[rest] + start
        ids = np.concatenate(rests)[np.repeat(source - begins, length) + np.arange(ends[-1])]
        doc, own_start, total = (pa.array(c, pa.int64()).take(pa.array(rest)) for c in zip(*held))
        at = np.append(0, 4 * ends).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(at), pa.py_buffer(ids)])
        columns = [doc, pa.array(own_start.to_numpy() + start), pa.array(length), total, pa.array(first + window), pa.array(offset), binary]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(NAMES, zip(*rows))], NAMES
        )

    for batch in batches:
        for block in text_blocks(batch, "text", ENCODED_BYTES):
            ids, offsets = encoder(path).encode(block.batch["text"])
            ids = ids.astype("<u4")
            out: list[tuple] = []
            for doc, a, b in zip(block.batch["doc_id"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                at = 0
                for length in [capacity] * ((b - a) // capacity):
                    out.append((doc, at, length, b - a, sequence, 0, ids[a + at : a + at + length].tobytes()))
                    sequence += 1
                    at += length
                if at < b - a:
                    held.append((doc, at, b - a))
                    rests.append(ids[a + at : b].copy())
                    size += b - a - at
                if size >= GROUP_WINDOWS * capacity:
                    yield grouped()
                    held, rests, size = [], [], 0
            if out:
                yield batch_of(out)
    if held:
        yield grouped()
    encoder(path).forget()


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per piece: doc_id, start in its document, length, doc_tokens, its sequence and place there, and its ids
    as little-endian unsigned 32-bit numbers. A sequence has at most `capacity` ids; `tokenizer` names the vocabulary
    file, which every executor has."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: _pack_rows(batches, tokenizer, capacity), PIECES)
