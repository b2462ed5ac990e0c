"""Benchmark decontamination: documents that hold a near copy of a benchmark item.

Texts are words in lower case (A-Z). An item of m words is looked for in all windows of m words of every document (in
the whole document if that is shorter). Windows without any five-word shingle of an item have similarity zero and are
passed over; each other window gets a SimHash of its shingles, from prefix sums over their bits. Its item must lie
within RADIUS bits: the 64 bits are cut into BLOCKS blocks, and two fingerprints within RADIUS bits differ by no more
than RADIUS // BLOCKS bits in one block at least, so looking up each block with that many bits flipped finds them all.
Candidates are verified by the weighted Jaccard similarity of their shingles (sum of smaller over sum of larger
counts), which must reach `least`.

A pair of similarity 0.8 differs by 9 to 10 bits on average (standard deviation 3), so a radius of 23 leaves out about
one such pair in 100,000, and fewer of closer ones.

Items are read in blocks of ITEM_BLOCK; each block is sent to the executors and meets all documents.

Defined results: null and empty texts hold nothing, and null or empty items are in no document; an item shorter than
five words has its whole word sequence as its one shingle; repeated items and documents give a row each; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import LOWER, TextBlock, frees_memory, mixed, prefix_sums, shingle_hashes, span_hashes, text_blocks
from tabgate.llm.quality_rules import without
from tabgate.llm.tables import bounded_batches, row_key

WIDTH = 5
RADIUS = 23
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS
#: So many items go to the executors at a time; an item of 1,000 words takes about 16 kB there.
ITEM_BLOCK = 5_000
#: Windows are fingerprinted in pieces of this many.
WINDOWS_AT_ONCE = 1 << 13
#: One bit for the low bits of each item shingle's hash, to pass over others quickly.
SIEVE_BITS = 22

FLIPS = np.array(
    [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)], np.int64
)


def word_hashes(text: bytes) -> np.ndarray:
    buf = LOWER[np.frombuffer(text, np.uint8)]
    block = TextBlock(None, buf, np.array([0, len(buf)]))
    return mixed(span_hashes(prefix_sums(buf), block.starts, block.ends))


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash, lowest first."""
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """A block of items: their shingles, fingerprints and the tables that find these by their blocks of bits."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        words = [(i, word_hashes((t or "").encode())) for i, t in rows]
        words = [(i, w) for i, w in words if len(w)]
        self.ids = np.array([i for i, _ in words], np.int64)
        self.sizes = np.array([len(w) for _, w in words], np.int64)
        self.shingles = [shingle_hashes(w, min(WIDTH, len(w))) for _, w in words]
        ones = [bits_of(s).sum(axis=0, dtype=np.int64) * 2 > len(s) for s in self.shingles]
        prints = packed(np.array(ones, np.uint8)) if words else np.zeros(0, np.uint64)
        self.prints = prints
        self.counts = [np.unique(s, return_counts=True) for s in self.shingles]
        # Items of five words and more are found by five-word shingles, shorter ones by shingles of their own length.
        self.by_width = {}
        for width in sorted({min(WIDTH, n) for n in self.sizes.tolist()}):
            own = np.flatnonzero(np.minimum(self.sizes, WIDTH) == width)
            shingle = np.concatenate([self.counts[i][0] for i in own])
            item = np.repeat(own, [len(self.counts[i][0]) for i in own])
            by = np.argsort(shingle, kind="stable")
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[shingle & np.uint64((1 << SIEVE_BITS) - 1)] = True
            self.by_width[width] = (shingle[by], item[by], sieve)
        # For each block, a bucket for each value: the items whose block is that value but for some flipped bits.
        self.buckets = []
        for b in range(BLOCKS):
            value = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            reached = (value[:, None] ^ FLIPS[None, :]).ravel()
            by = np.argsort(reached, kind="stable")
            item = np.repeat(np.arange(len(prints)), len(FLIPS))[by]
            self.buckets.append((np.searchsorted(reached[by], np.arange((1 << BLOCK_BITS) + 1)), item))

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in prints, item) within the radius."""
        found = []
        for b, (edges, items) in enumerate(self.buckets):
            value = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = edges[value + 1] - edges[value]
            at = np.repeat(np.arange(len(prints)), n)
            item = items[np.repeat(edges[value] - np.cumsum(n) + n, n) + np.arange(len(at))]
            near = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
            found.append(at[near] * len(self.prints) + item[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        own, n = np.unique(shingles, return_counts=True)
        values, counts = self.counts[item]
        _, x, y = np.intersect1d(own, values, assume_unique=True, return_indices=True)
        shared = int(np.minimum(n[x], counts[y]).sum())
        return shared / (int(n.sum()) + int(counts.sum()) - shared)


def _matches(words: np.ndarray, items: Items, least: float) -> list[tuple[int, int, int, float]]:
    """(item, first word, words, similarity) of the best window for each item that the text holds."""
    best: dict[int, tuple[float, int, int]] = {}
    for width, (shingle, item_of, _) in items.by_width.items():
        own = shingle_hashes(words, width)
        if not len(own):
            continue
        first, last = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
        hit = np.flatnonzero(last > first)
        if not len(hit):
            continue
        n = (last - first)[hit]
        at = np.repeat(hit, n)
        item = item_of[np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(len(at))]
        for size in np.unique(items.sizes[item]).tolist():
            # Item-sized windows over any shingle of an item of that size.
            held, span = min(size, len(words)), min(size, len(words)) - width + 1
            steps = np.zeros(len(own) + 1, np.int64)
            places = np.unique(at[items.sizes[item] == size])
            np.add.at(steps, np.maximum(places - span + 1, 0), 1)
            np.add.at(steps, np.minimum(places, len(own) - span) + 1, -1)
            starts = np.flatnonzero(np.cumsum(steps)[: len(own) - span + 1] > 0)
            for some in np.split(starts, range(WINDOWS_AT_ONCE, len(starts), WINDOWS_AT_ONCE)):
                if not len(some):
                    continue
                low = int(some[0])
                ones = np.zeros((int(some[-1]) + span - low + 1, 64), np.int32)
                np.cumsum(bits_of(own[low : int(some[-1]) + span]), axis=0, out=ones[1:])
                counts = ones[some - low + span] - ones[some - low]
                near, which = items.within_radius(packed((2 * counts > span).astype(np.uint8)))
                right = items.sizes[which] == size
                for start, i in zip(some[near[right]].tolist(), which[right].tolist()):
                    s = items.similarity(own[start : start + span], i)
                    if s >= least and (i not in best or s > best[i][0]):
                        best[i] = (s, start, held)
    return [(i, start, n, s) for i, (s, start, n) in sorted(best.items())]


LEAKS = "_id long, _key long, doc_id long, item_id long, similarity double, first_word long, n_words long"


@frees_memory
def _leak_rows(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch, "text"):
            words = block.word_hashes(lower=True)
            some = np.zeros(len(block), bool)
            for width, (_, _, sieve) in items.by_width.items():
                own = shingle_hashes(words, width)
                hit = np.flatnonzero(sieve[own & np.uint64((1 << SIEVE_BITS) - 1)])
                some[block.text_of_word[hit]] = True  # a shingle over a text's end may pass here, not below
            out = [
                (t, *match)
                for t in np.flatnonzero(some).tolist()
                for match in _matches(words[block.word_offsets[t] : block.word_offsets[t + 1]], items, least)
            ]
            if out:
                text, item, start, n, s = zip(*out)
                of = pa.array(text, pa.int64())
                columns = [block.batch[c].take(of) for c in ("_id", "_key", "doc_id")]
                columns += [pa.array(items.ids[list(item)]), pa.array(s, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in LEAKS.split(", ")])


def leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each document and item it holds, at its most similar window."""
    bounded_batches(docs.sparkSession)
    ident, key = row_key(text, doc_id)
    rows = docs.select(ident, key, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    found = spark.createDataFrame([], LEAKS)
    block: list[tuple] = []

    def meet(found: DataFrame) -> DataFrame:
        items = spark.sparkContext.broadcast(Items(block))
        return found.unionByName(rows.mapInArrow(lambda batches: _leak_rows(batches, items.value, least), LEAKS))

    for item in benchmark.select(F.col(item_id).cast("long"), F.col(item_text)).toLocalIterator():
        block.append(tuple(item))
        if len(block) == ITEM_BLOCK:
            found, block = meet(found), []
    return meet(found) if block else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    return without(docs, leaks(docs, benchmark, least, text, doc_id).select("_id", "_key").distinct(), text, doc_id)
