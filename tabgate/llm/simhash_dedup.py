"""SimHash near-duplicates: fingerprints, links by pivot distance tables, classes of linked documents.

Fingerprints that agree in enough blocks of bits meet in a bucket: with k blocks and a radius of r differing bits, at
least k - r blocks are untouched, so every linked pair agrees on some choice of k - r blocks, and each choice is a
bucket key. In a bucket, a table holds the Hamming distances of each fingerprint to many fixed reference
fingerprints (the pivots). By the triangle inequality a pair within the radius differs by no more than the radius in
each of these coordinates; pairs that differ more in any are discarded, the rest is verified bit by bit. (Distances to
pivots alone can't be keys: those of unrelated fingerprints lie within 4 of each other more than half the time.)

Equal fingerprints are one node, so a group of copies is never paired. A bucket links each fingerprint to the smallest
one its verified pairs join it with, which joins what all its pairs would.

Defined results: a null or empty text has the fingerprint zero, which links like any other; repeated rows get the same
result each; rows without id link like any other, but don't name a class: one of such rows alone has a null name; further
columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import LOWER, frees_memory, mixed, prefix_sums, shingle_hashes, span_hashes, text_blocks
from tabgate.llm.components import components
from tabgate.llm.quality_rules import sent_if_few, without
from tabgate.llm.tables import NO_ID, bounded_batches, row_key, stage

N_PIVOTS = 24
PIVOTS = mixed(np.arange(1, N_PIVOTS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
#: Pairs are tested in pieces of at most this many.
PAIRS_AT_ONCE = 1 << 20


def fingerprint(shingles: list[bytes]) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42); 0 without shingles."""
    if not shingles:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def text_fingerprint(text: bytes, width: int) -> int:
    """Of the text's `width`-word shingles in lower case (A-Z), repeats included."""
    words = text.lower().split()
    if len(words) <= width:
        return fingerprint([b" ".join(words)] if words else [])
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return fingerprint([joined[a:b] for a, b in zip(starts[: 1 - width or None].tolist(), ends[width - 1 :].tolist())])


def word_set_fingerprint(text: bytes) -> int:
    """Of the distinct words. A changed word alters one feature of many here, but five five-word shingles."""
    return fingerprint(sorted(set(text.lower().split())))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


#: Bands of min-hashes: a pair of similarity s shares one with a chance of 1 - (1 - s ** BAND_ROWS) ** BANDS.
BANDS, BAND_ROWS = 16, 4
ORDERS = mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
SHINGLES_AT_ONCE = 4096


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of the set's least hashes under BANDS * BAND_ROWS orders; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        some = shingles[None, at : at + SHINGLES_AT_ONCE]
        np.minimum(least, ((some ^ (ORDERS[:, None] >> np.uint64(7))) * ORDERS[:, None]).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = mixed(keys ^ row)
    return keys.view(np.int64)


def fingerprints(
    docs: DataFrame, width: int = 4, word_sets: bool = False, bands: bool = False, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, _key, fp[, bands]): fp is the 64-bit fingerprint as a signed number, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                texts = list(block.texts())
                fps = [_signed(word_set_fingerprint(t) if word_sets else text_fingerprint(t, width)) for t in texts]
                columns = {"doc_id": block.batch["doc_id"], "_key": block.batch["_key"], "fp": pa.array(fps, pa.int64())}
                if bands:
                    columns["bands"] = pa.array([band_keys(shingle_set(t, width)) for t in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(text, doc_id)[1], F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, _key long, fp long" + (", bands array<long>" if bands else ""))


def n_blocks(n: int, radius: int) -> int:
    """The fewest blocks whose shared bits, 64 * (k - r) / k, tell n fingerprints apart to some dozens a bucket.

    Any number above the radius finds the same links; more blocks mean more keys and smaller buckets.
    """
    k = radius + 1
    while 64 * (k - radius) // k < n.bit_length() - 3 and comb(k + 1, radius) <= 250:
        k += 1
    return k


def _masks(k: int, radius: int) -> list[int]:
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(blocks[i] for i in chosen) for chosen in combinations(range(k), k - radius)]


def near_pairs(fps: np.ndarray, buckets: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within the radius and of one bucket, by pivot tables, in pieces of bounded size."""
    table = np.bitwise_count(fps[None, :] ^ PIVOTS[:, None])  # pivots x fingerprints
    # Sorted by bucket and first coordinate, the partners of a row that may be near in it follow the row at once.
    place = np.unique(buckets, return_inverse=True)[1].astype(np.int64) * 128 + table[0]
    order = np.argsort(place, kind="stable")
    place, table, fps = place[order], table[:, order].astype(np.int8), fps[order]
    following = np.searchsorted(place, place + radius, "right") - np.arange(len(fps)) - 1
    sums = np.cumsum(following)
    at, done = 0, 0
    while at < len(fps):
        end = max(at + 1, int(np.searchsorted(sums, done + PAIRS_AT_ONCE, "right")))
        counts = following[at:end]
        a = np.repeat(np.arange(at, end), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        at, done = end, int(sums[end - 1])
        for coordinate in table[1:]:
            if not len(a):
                break
            near = np.abs(coordinate[a] - coordinate[b]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        if near.any():
            yield order[a[near]], order[b[near]]


def labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions the smallest one that the pairs join it with."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            p, q = label[a], label[b]
            apart = p != q
            if not apart.any():
                break
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while True:
                short = label[label]
                if np.array_equal(short, label):
                    break
                label = short
    return label


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> links. A bucket may cross batches; one fingerprint takes 24 bytes."""

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        root = labels(len(rows), near_pairs(rows[:, 1].copy().view(np.uint64), rows[:, 0], radius))
        own = np.flatnonzero(root != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[own, 2]), pa.array(rows[root[own], 2])], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy() for c in ("bucket", "fp", "node")])
        if not len(rows):
            continue
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # what follows may still grow
        if last or (held and held[0][-1, 0] != rows[0, 0]):
            yield linked(np.concatenate([*held, rows[:last]]))
            held = []
        held.append(rows[last:])
    if held:
        yield linked(np.concatenate(held))


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(fp, node) with distinct fingerprints -> links (a, b) between nodes, enough to join all within the radius."""
    masks = _masks(n_blocks(nodes.count(), radius), radius)
    choices = F.array(*[
        F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("bucket")) for i, m in enumerate(masks)
    ])
    rows = nodes.select("fp", "node", F.explode(choices).alias("x")).select("x.bucket", "fp", "node")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: _bucket_links(batches, radius), "a long, b long")


def classes(printed: DataFrame, radius: int) -> DataFrame:
    """(doc_id, ..., fp) -> the same rows with component_id, the smallest doc_id reachable over links.

    Fingerprints stand for themselves in the links, whether their rows have ids or not; classes are named afterwards.
    """
    nodes = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    joined = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    placed = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = stage(placed, "classes")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return printed.join(placed.join(named, "component").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id."""
    printed = stage(fingerprints(docs, width, text=text, doc_id=doc_id), "fingerprints")
    return classes(printed, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- one document of each group ----


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words: the whole sequence; none: no shingle."""
    buf = LOWER[np.frombuffer(text, np.uint8)]
    words = bytes(buf).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate([[0], ends[:-1]])
    hashes = mixed(span_hashes(prefix_sums(joined), starts, ends))
    return np.unique(shingle_hashes(hashes, min(width, len(words))))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


SETS = "component long, first long, _key long, shingles binary"


@frees_memory
def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch, "text"):
            sets = [shingle_set(t, width).tobytes() for t in block.texts()]
            part = block.batch
            yield pa.RecordBatch.from_arrays(
                [part["component"], part["first"], part["_key"], pa.array(sets, pa.binary())], ["component", "first", "_key", "shingles"]
            )


def _like_leader(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = [
            similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) < least
            for x, y in zip(batch["shingles"], batch["led"])
        ]
        yield batch.filter(pa.array(far, pa.bool_())).select(["component", "first", "_key", "shingles"])


class Kept:
    """Shingle sets that stay, found by the shingles they share with another one.

    The prefix of a set of n hashes are its n - ceil(least * n) + 1 smallest. Two sets of similarity `least` share a hash
    of their prefixes, as all that is shared would otherwise lie in what is left of one. More than that: they share
    `least` / (1 + `least`) of both sizes together, and what isn't in both prefixes lies in the rest of one of them, so
    all but the longer rest must be shared by the prefixes.
    """

    def __init__(self, least: float) -> None:
        self.least = least
        self.sets: list[np.ndarray] = []
        self.sizes = array("q")
        self.holders: dict[int, array] = {}

    def _rest(self, sizes: np.ndarray) -> np.ndarray:
        return np.ceil(self.least * sizes - 1e-9) - 1

    def _near(self, n: int, lists: list[array]) -> np.ndarray:
        """Which kept sets may be like one of size n, whose prefix is held in these lists; the likeliest first."""
        sizes = np.array(self.sizes)
        shared = np.bincount(np.frombuffer(b"".join(lists), np.int32), minlength=len(sizes))
        needed = np.ceil(self.least / (1 + self.least) * (n + sizes) - 1e-9) - self._rest(np.maximum(n, sizes))
        near = (shared >= np.maximum(needed, 1)) & (np.minimum(n, sizes) >= self.least * np.maximum(n, sizes) - 1e-9)
        found = np.flatnonzero(near)
        return found[np.argsort(-shared[found], kind="stable")]

    def takes(self, own: np.ndarray) -> bool:
        """Keeps the set unless it is like one kept before."""
        n = len(own)
        prefix = own[: n - int(self._rest(np.int64(n)))].tolist() if n else [-1]  # sets without a shingle are alike
        lists = [self.holders[h] for h in prefix if h in self.holders]
        if lists and any(similarity(own, self.sets[i]) >= self.least for i in self._near(n, lists).tolist()):
            return False
        for h in prefix:
            self.holders.setdefault(h, array("i")).append(len(self.sets))
        self.sets.append(own)
        self.sizes.append(n)
        return True


def _leaders(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, first id and key -> those that are like no earlier row kept of their component."""
    component, kept = None, Kept(least)
    for batch in batches:
        out = []
        for c, first, key, raw in zip(*[batch[x].to_pylist() for x in ("component", "first", "_key")], batch["shingles"]):
            if c != component:
                component, kept = c, Kept(least)
            if kept.takes(np.frombuffer(raw.as_py(), np.uint64)):
                out.append((c, first, key))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["component", "first", "_key"])


#: Stands for the id of a text whose rows have none: it comes last.
LAST_ID = (1 << 63) - 1


def keep_one(
    docs: DataFrame, least: float = 0.8, width: int = 5, radius: int = 6, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The documents without near copies of kept ones, with all their columns.

    Candidates are texts joined by links, of two kinds: fingerprints of their word sets within `radius` bits, and a common
    band of min-hashes of their `width`-word shingles. A pair of similarity 0.8 is missed by the bands with a chance of
    2 in 10,000, one of 0.85 of 1 in 100,000. Within such a class, in order of doc_id (texts without one last, by
    their hashes), a text goes if its shingles have a similarity of at least `least` to those of one that stays. So
    one document of each group stays, and nothing goes that isn't like one that stays. Of rows of one text, one of the
    first id stays, also where rows are repeated or have no id.

    Texts of a class are first compared with its first one, in a join that needs no class in one task, again and again
    while classes stay large and shrink; the rest of each class then goes through in order, holding only the sets of
    those that stay and looking them up by shared shingles.
    """
    printed = stage(fingerprints(docs, width, word_sets=True, bands=True, text=text, doc_id=doc_id), "fingerprints")
    # Equal texts are one candidate.
    own_id = F.coalesce("doc_id", F.lit(LAST_ID))
    texts = stage(
        printed.groupBy("_key").agg(F.min("fp").alias("fp"), F.min(own_id).alias("first"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")),
        "texts",
    )
    nodes = stage(texts.groupBy("fp").agg(F.min("_key").alias("node")), "nodes")
    same_print = texts.join(nodes, "fp").select(F.col("_key").alias("a"), F.col("node").alias("b"))
    banded = texts.select("_key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("_key").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "b")
    same_band = banded.join(shared, "band").select(F.col("_key").alias("a"), "b")
    joined = components(links(nodes, radius).unionByName(same_print).unionByName(same_band))
    members = stage(joined.join(texts.select("_key", "first"), F.col("node") == F.col("_key")).select("component", "first", "_key"), "members")
    first_id = F.when(F.col("first") == LAST_ID, F.lit(NO_ID)).otherwise(F.col("first")).alias("_id")
    ident, key = row_key(text, doc_id)
    with_text = docs.select(ident, key, F.col(text).alias("text")).join(sent_if_few(members.select(first_id, "*")), ["_id", "_key"])
    rest = stage(
        with_text.select("component", "first", "_key", "text").mapInArrow(lambda b: _sets(b, width), SETS).dropDuplicates(["first", "_key"]),
        "shingle-sets",
    )
    first_ones = []
    n = rest.count()
    while n:
        heads = rest.groupBy("component").agg(F.min(F.struct("first", "_key")).alias("head"))
        largest = rest.groupBy("component").count().agg(F.max("count")).first()[0]
        if largest <= 500:
            break
        leaders = rest.join(heads, "component").filter("first = head.first AND _key = head._key").select("component", "first", "_key", "shingles")
        leaders = stage(leaders, "leaders")
        first_ones.append(leaders.select("component", "first", "_key"))
        led = rest.join(leaders.select("component", F.col("shingles").alias("led")), "component")
        left = stage(led.mapInArrow(lambda b: _like_leader(b, least), SETS), "shingle-sets")
        before, n, rest = n, left.count(), left
        if n > 0.98 * before:
            break
    ordered = rest.repartition("component").sortWithinPartitions("component", "first", "_key")
    kept = ordered.mapInArrow(lambda b: _leaders(b, least), "component long, first long, _key long")
    for some in first_ones:
        kept = kept.unionByName(some)
    like = members.join(kept.select("first", "_key"), ["first", "_key"], "left_anti").select(first_id, "_key")
    ids = printed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), own_id.alias("_own"), "_key")
    copies = ids.join(texts.filter("n > 1").select("_key", "first"), "_key").filter("_own != first").select("_id", "_key")
    gone = stage(like.unionByName(copies).distinct(), "gone")
    # Rows equal in id and text can't be told by these: one of them is taken.
    repeated = ids.join(texts.filter("n > 1").select("_key"), "_key").groupBy("_id", "_key").count().filter("count > 1")
    repeated = stage(repeated.join(gone, ["_id", "_key"], "left_anti").select("_id", "_key"), "repeated")
    if not repeated.count():
        return without(docs, gone, text, doc_id)
    again = F.struct(*docs.columns).alias("_row")
    ones = docs.select(ident, key, again).join(sent_if_few(repeated), ["_id", "_key"]).dropDuplicates(["_id", "_key"]).select("_row.*")
    return without(docs, gone.unionByName(repeated), text, doc_id).unionByName(ones)
