"""Removal of repeated passages by suffix arrays: bytes under any `length`-byte string that starts twice.

Equal strings must meet in one task, without sending every string of the corpus. So each `length`-byte window of a
text is put under an *anchor*: the leftmost smallest of the hashes of its GRAM-byte pieces. Equal windows have the same
anchor at the same place, whatever stands around them. Neighbouring windows under one anchor are a *segment*; only the
hashes of segments are shuffled at first. Anchors seen once hold no repeated window. Segments that are equal byte by
byte become one row with their number, and an anchor with one such row is settled by that number. The texts of all
other segments are fetched, those of an anchor meet in one task, and there a suffix array tells which windows
occur twice:

  * suffixes smaller than their successor (type S) are sorted directly, to a depth of `length` bytes;
  * all others (type L) are induced: a scan over the sorted buckets of first bytes puts, for each suffix met, the one
    that starts a byte before it at the next place of its own bucket;
  * common prefixes of neighbours in that order are compared; windows that share `length` bytes with one are repeated.

An anchor with more than HOT_SEGMENTS different segments would not fit a task. Its windows are told apart by their own
hashes instead, which are counted like any group: an exact way with bounded memory for such anchors.

Defined results: a null text is empty; texts below `length` bytes lose nothing; a row that occurs twice loses all from
`length` bytes on; further columns are not read. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import BASE_INVERSE, frees_memory, mixed, powers, prefix_sums, span_hashes, text_blocks
from tabgate.llm.tables import bounded_batches, row_key, stage

LENGTH = 200
#: Bytes of the pieces that anchors are chosen among. Longer: fewer false partners, but more and so shorter segments.
GRAM = 48
#: Windows of a long text are looked at in runs of this many.
RUN = 1 << 20
#: A suffix array is built over about this many bytes of segments at a time.
BATCH_BYTES = 1 << 19
HOT_SEGMENTS = 20_000
#: Stands between segments; UTF-8 has no such byte.
BREAK = 0xFF
#: First bit of the place of a hash within a run, see `anchors`.
PLACE_BITS = 22


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(buf: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """All windows of the texts, as segments: text, start in it, n_windows, anchor, content (hashes)."""
    found: list[dict[str, np.ndarray]] = []
    n_windows = len(buf) - length + 1
    for first in range(0, max(0, n_windows), RUN):
        last = min(first + RUN, n_windows)
        part = buf[first : last + length - 1]
        sums = prefix_sums(part)
        pieces = np.arange(len(part) - GRAM + 1)
        hashes = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(BASE_INVERSE, len(sums))[: len(pieces)])
        # The place in the low bits: the least value is the leftmost of the least hashes.
        place = np.uint64((1 << PLACE_BITS) - 1)
        least = _sliding_least((hashes & ~place) | pieces.astype(np.uint64), length - GRAM + 1)
        anchor = (least & place).astype(np.int64)
        at = np.arange(first, last)
        text = np.searchsorted(offsets, at, "right") - 1
        whole = at + length <= offsets[text + 1]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new & whole)  # windows of a text that don't reach over its end come first
        if not len(starts):
            continue
        bounds = np.append(np.flatnonzero(new), len(at))
        ends = bounds[np.searchsorted(bounds, starts, "right")]
        wholes = np.concatenate([[0], np.cumsum(whole)])
        n = wholes[ends] - wholes[starts]
        own = anchor[starts]
        content = span_hashes(sums, starts, starts + n + length - 1)
        found.append(
            {
                "text": text[starts], "start": at[starts] - offsets[text[starts]], "n_windows": n,
                "anchor": hashes[own], "content": mixed(content + (n * 4096 + own - starts).astype(np.uint64)),
            }
        )
    names = ("text", "start", "n_windows", "anchor", "content")
    return {c: np.concatenate([np.zeros(0, np.int64), *[f[c].view(np.int64) for f in found]]) for c in names}


# ---- the suffix array ----


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(text)] << np.uint64(56 - 8 * k)
    return words


def _common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes, `depth` at most, the suffixes at a and b share; by halving over hashes of prefixes."""
    shared = np.zeros(len(a), np.int64)
    step = 1 << (depth.bit_length() - 1)
    end, inverse = len(sums) - 1, powers(BASE_INVERSE, len(sums))
    while step:
        x, y, to = a + shared, b + shared, shared + step
        fits = (to <= depth) & (a + to <= end) & (b + to <= end)
        x2, y2 = np.minimum(x + step, end), np.minimum(y + step, end)
        equal = fits & ((sums[x2] - sums[x]) * inverse[x] == (sums[y2] - sums[y]) * inverse[y])
        shared += step * equal
        step >>= 1
    return shared


def _sorted_directly(text: np.ndarray, words: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first `depth` bytes, at least.

    Ties are resolved group by group at the first byte where any member differs from the group's first, so each
    further round splits every group that is left.
    """
    order = suffixes[np.argsort(words[suffixes], kind="stable")]
    keys = words[order]
    head = np.ones(len(order), bool)
    head[1:] = keys[1:] != keys[:-1]
    sums = prefix_sums(text)
    while True:
        # Groups of two and more.
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(order)))
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        if not len(starts):
            return order
        group = np.repeat(np.arange(len(starts)), sizes)
        places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(len(group))
        members = order[places]
        shared = _common(sums, members, np.repeat(members[np.cumsum(sizes) - sizes], sizes), depth)
        skip = np.minimum.reduceat(np.where(shared >= depth, depth, shared), np.cumsum(sizes) - sizes)
        at = np.minimum(members + skip[group], len(text) - 1)
        keys = np.where(members + skip[group] < len(text), words[at], 0)
        keys[skip[group] >= depth] = 0
        by = np.lexsort((keys, group))
        order[places] = members[by]
        keys = keys[by]
        split = np.ones(len(by), bool)
        split[1:] = (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])
        # Equal to the full depth: their order doesn't matter, each is settled.
        split |= skip[group] >= depth
        head[:] = True
        head[places] = split


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes, ordered by at least their first `depth` bytes, by two-stage sorting."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    chars = text.astype(np.int64)
    # Type S: smaller than the successor. Within a run of one byte the next other byte decides; the last suffix is L.
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    run_end = change[np.searchsorted(change, np.arange(n))]
    small = (run_end < n - 1) & (text[np.minimum(run_end + 1, n - 1)] > text)
    ordered = _sorted_directly(text, _words(text), np.flatnonzero(small), depth)
    counts = np.bincount(chars, minlength=256)
    ends = np.cumsum(counts)
    result = np.full(n, -1, np.int64)
    s_counts = np.bincount(chars[ordered], minlength=256)
    s_starts = ends - s_counts  # in each bucket the L suffixes come first
    within = np.arange(len(ordered)) - np.repeat(np.cumsum(s_counts) - s_counts, s_counts)
    result[np.repeat(s_starts, s_counts) + within] = ordered
    free = ends - counts

    def put(suffixes: np.ndarray) -> None:
        own = text[suffixes]
        by = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=256)
        first = np.cumsum(sizes) - sizes
        own = own[by]
        result[free[own] + np.arange(len(by)) - first[own]] = suffixes[by]
        np.add(free, sizes, out=free)

    put(np.array([n - 1]))
    for c in np.flatnonzero(counts).tolist():
        seen = int(ends[c] - counts[c])
        while seen < free[c]:  # what is put into this bucket meanwhile makes a further wave
            wave = result[seen : free[c]]
            seen = int(free[c])
            before = wave[wave > 0] - 1
            put(before[text[before] >= c])
        before = result[s_starts[c] : ends[c]]
        before = before[before > 0] - 1
        put(before[text[before] > c])
    return result


def repeated_windows(text: np.ndarray, window: np.ndarray, length: int) -> np.ndarray:
    """For each place, whether the window that starts there (where `window` holds) equals another one."""
    order = suffix_array(text, length)
    order = order[window[order]]
    a, b = order[:-1], order[1:]
    words = _words(text)
    for k in range(0, length - 7, 8):  # adjacent common prefixes; most end early
        same = words[a + k] == words[b + k]
        a, b = a[same], b[same]
    for k in range(length - length % 8, length):
        same = text[a + k] == text[b + k]
        a, b = a[same], b[same]
    found = np.zeros(len(text), bool)
    found[a] = True
    found[b] = True
    return found


def _runs(flags: np.ndarray) -> list[int]:
    """from, to, from, to ... of the runs of true flags."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


# ---- the job ----

SEGMENTS = "_id long, _key long, start int, n_windows int, anchor long, content long"
TEXTS = "anchor long, content long, n long, n_windows int, piece binary"
RUNS = "anchor long, content long, runs array<int>"


@frees_memory
def _segment_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch, "text"):
            s = segments(block.buf, block.offsets, length)
            of = pa.array(s["text"])
            columns = [block.batch["_id"].take(of), block.batch["_key"].take(of), pa.array(s["start"].astype(np.int32)),
                       pa.array(s["n_windows"].astype(np.int32)), pa.array(s["anchor"]), pa.array(s["content"])]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_key", "start", "n_windows", "anchor", "content"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts pressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for block in text_blocks(batch, "text"):
            packed = pa.array([press.compress(t) for t in block.texts()], pa.binary())
            yield pa.RecordBatch.from_arrays([block.batch[c] for c in block.batch.schema.names[:-1]] + [packed], block.batch.schema.names)


def _unpack(packed: bytes) -> bytes:
    return zstandard.decompress(packed) if packed else b""


@frees_memory
def _piece_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Packed texts with the segments wanted of them -> the segments' bytes."""
    for batch in batches:
        for packed, wanted in zip(batch["text"], batch["wanted"]):
            text = _unpack(packed.as_py())
            rows = wanted.values.flatten()
            anchor, content, n, start, n_windows = rows
            starts, counts = start.to_numpy(), n_windows.to_numpy()
            for at in range(0, len(starts), 1 << 14):
                some = slice(at, at + (1 << 14))
                pieces = [text[a : a + k + length - 1] for a, k in zip(starts[some].tolist(), counts[some].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [x.slice(at, 1 << 14) for x in (anchor, content, n, n_windows)] + [pa.array(pieces, pa.binary())],
                    ["anchor", "content", "n", "n_windows", "piece"],
                )


@frees_memory
def _array_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor -> for those with repeated windows, the runs of these."""
    held: list[tuple] = []

    def judge() -> pa.RecordBatch:
        anchor, content, n, n_windows, pieces = zip(*held)
        text = np.frombuffer(bytes([BREAK]).join(pieces) + bytes([BREAK] * 8), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        starts = np.cumsum(sizes) - sizes
        counts = np.array(n_windows, np.int64)
        steps = np.zeros(len(text) + 1, np.int8)
        steps[starts] += 1
        np.add.at(steps, starts + counts, -1)
        found = repeated_windows(text, np.cumsum(steps[:-1], dtype=np.int8) > 0, length)
        out = []
        for i, (a, k, many) in enumerate(zip(starts.tolist(), n_windows, n)):
            runs = [0, k] if many > 1 else _runs(found[a : a + k])
            if runs:
                out.append((anchor[i], content[i], runs))
        columns = list(zip(*out)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "content", "runs"])

    size = 0
    for batch in batches:
        for row in zip(*[batch[c].to_pylist() for c in ("anchor", "content", "n", "n_windows", "piece")]):
            if size >= BATCH_BYTES and row[0] != held[-1][0]:
                yield judge()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield judge()


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of segments of a hot anchor, each with a hash of its bytes."""
    for batch in batches:
        for row in range(batch.num_rows):
            buf = np.frombuffer(batch["piece"][row].as_py(), np.uint8)
            at = np.arange(batch["n_windows"][row].as_py())
            hashes = mixed(span_hashes(prefix_sums(buf), at, at + length)).view(np.int64)
            columns = [pa.repeat(batch[c][row], len(at)) for c in ("anchor", "content", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), pa.array(hashes)], ["anchor", "content", "n", "at", "window"])


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(_id, _key, spans): for each text that loses bytes, from, to, from, to ... of maximal runs; and the packed texts."""
    bounded_batches(docs.sparkSession)
    ident, key = row_key(text, doc_id)
    rows = docs.select(ident, key, F.col(text).alias("text"))
    found = stage(rows.mapInArrow(lambda b: _segment_rows(b, length), SEGMENTS), "segments")
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    # Stored first: the join then deals both sides anew, and the planner may split an anchor with very many segments.
    twice = stage(anchors.filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike")), "shared-anchors")
    seen = stage(found.join(twice, "anchor"), "shared-segments")
    # Equal segments are one row, with their number and the place of one of them.
    kinds = stage(
        seen.filter("NOT alike").groupBy("anchor", "content")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_key", "start", "n_windows")).alias("of")),
        "kinds",
    )
    wanted = kinds.groupBy(F.col("of._id").alias("_id"), F.col("of._key").alias("_key")).agg(
        F.collect_list(F.struct("anchor", "content", "n", "of.start", "of.n_windows")).alias("wanted")
    )
    packed = rows.mapInArrow(_pack, "_id long, _key long, text binary")
    pieces = packed.join(wanted, ["_id", "_key"]).select("text", "wanted").mapInArrow(lambda b: _piece_rows(b, length), TEXTS)
    hot = stage(kinds.groupBy("anchor").count().filter(F.col("count") > HOT_SEGMENTS).select("anchor"), "hot-anchors")
    if hot.isEmpty():
        cold, counted = pieces, None
    else:
        pieces = stage(pieces, "pieces")
        cold = pieces.join(hot, "anchor", "left_anti")
        windows = stage(
            pieces.join(hot, "anchor").mapInArrow(lambda b: _window_rows(b, length), "anchor long, content long, n long, at int, window long"),
            "hot-windows",
        )
        again = windows.groupBy("anchor", "window").agg(F.sum("n").alias("n_all")).filter("n_all > 1").select("anchor", "window")
        counted = windows.join(again, ["anchor", "window"]).groupBy("anchor", "content").agg(
            F.flatten(F.transform(F.array_sort(F.collect_set("at")), lambda x: F.array(x, x + 1))).alias("runs")
        )
    judged = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _array_rows(b, length), RUNS)
    if counted is not None:
        judged = judged.unionByName(counted)
    runs = stage(judged, "repeated")
    alike = seen.filter("alike").select("_id", "_key", "start", F.array(F.lit(0), F.col("n_windows")).alias("runs"))
    unlike = seen.filter("NOT alike").join(runs, ["anchor", "content"]).select("_id", "_key", "start", "runs")
    spans = alike.unionByName(unlike).groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "runs")).alias("found"))
    return spans, packed


def _merged(found: list[dict] | None, length: int) -> np.ndarray:
    """Maximal removed runs, one (from, to) a row."""
    pairs = [(s["start"] + a, s["start"] + b + length - 1) for s in found or () for a, b in zip(s["runs"][::2], s["runs"][1::2])]
    if not pairs:
        return np.zeros((0, 2), np.int64)
    table = np.array(sorted(pairs))
    reach = np.maximum.accumulate(table[:, 1])
    first = np.flatnonzero(np.concatenate([[True], table[1:, 0] > reach[:-1]]))
    return np.column_stack([table[first, 0], reach[np.append(first[1:], len(table)) - 1]])


def _cut(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@frees_memory
def _digest_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for packed, found in zip(batch["text"], batch["found"]):
            text, spans = _unpack(packed.as_py()), _merged(found.as_py(), length)
            kept = _cut(text, spans)
            out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _with_spans(docs: DataFrame, length: int, text: str, doc_id: str, carried: list[Column]) -> DataFrame:
    spans, _ = repeats(docs, text, doc_id, length)
    ident, key = row_key(text, doc_id)
    packed = docs.select(ident, key, *carried, F.col(text).alias("text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields[:-1])
    return packed.mapInArrow(_pack, f"{shape}, text binary").join(spans, ["_id", "_key"], "left")


def repeat_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Per document: its bytes, how many are removed in how many runs, and the SHA-256 of the rest."""
    rows = _with_spans(docs, length, text, doc_id, [F.col(doc_id).cast("long").alias("doc_id")])
    return rows.select("doc_id", "text", "found").mapInArrow(lambda b: _digest_rows(b, length), RESULT)


@frees_memory
def _cut_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A cut may part the bytes of a character; the pieces of it go too.
        texts = [
            None if missing else _cut(_unpack(packed.as_py()), _merged(found.as_py(), length)).decode("utf-8", "ignore")
            for packed, found, missing in zip(batch["text"], batch["found"], batch["_null"].to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(texts, pa.string())], ["_row", "_text"])


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """The documents with their repeated passages cut out of the text, with all their columns."""
    others = F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("_row")
    rows = _with_spans(docs, length, text, doc_id, [others, F.col(text).isNull().alias("_null")])
    shape = f"_row {dict(rows.dtypes)['_row']}, _text string"
    cut = rows.select("_row", "_null", "text", "found").mapInArrow(lambda b: _cut_rows(b, length), shape)
    return cut.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
