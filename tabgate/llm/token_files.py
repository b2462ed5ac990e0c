"""Token ids in binary files of patched frame-of-reference blocks, and reading them back.

A file holds the ids of a range of documents in ascending order of doc_id. BLOCK ids make a block: its least id is
subtracted, the rest is packed at the width that the PERCENTILE-th of a hundred differences needs, and the larger ones
are exceptions, listed with their places. After the blocks come the index of block starts and the documents' ids and
bounds, so any document is read by going to its blocks.

File (little-endian): MAGIC; blocks; block starts (u64 each, one more than blocks); doc ids (i64); 1 for each doc
without id (u8); doc starts (u64, one more than documents); footer: blocks, documents, place of the index (u64 each),
MAGIC. Block: ids (u16), exceptions (u16), width (u8), least id (u32), packed bits, places (u16), values (u32).

A task writes its file under a name of its own attempt; only files that the finished job lists are read, so a task that
is run again, or twice, leaves no second copy of its ids in the result.

Defined results: null and empty texts have the end id alone; documents of equal id follow each other in the order of
their texts' hashes; rows without id come first; further columns are not read; an empty table gives no file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import frees_memory, text_blocks
from tabgate.llm.tables import bounded_batches, stage
from tabgate.llm.tokens import ENCODED_BYTES, encoder
from tabgate.session import scratch_path

MAGIC = b"PFORIDS1"
BLOCK = 512
PERCENTILE = 95
HEAD = struct.Struct("<HHBI")
FOOTER = struct.Struct("<QQQ8s")
#: So many blocks are encoded or decoded at a time.
BLOCKS_AT_ONCE = 512


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """One string of bytes for each BLOCK ids; the last may hold fewer."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    tables = [t for t in (ids[:whole].reshape(-1, BLOCK), ids[whole:].reshape(1, -1)) if t.size]
    for table in tables:
        n = table.shape[1]
        least = table.min(axis=1)
        rest = (table - least[:, None]).astype(np.int64)
        at = min(n - 1, n * PERCENTILE // 100)
        widths = np.frompyfunc(int.bit_length, 1, 1)(np.partition(rest, at, axis=1)[:, at]).astype(np.int64)
        blocks: list[bytes] = [b""] * len(table)
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            values = rest[own]
            large = values >> width > 0
            bits = ((np.where(large, 0, values)[:, :, None] >> np.arange(width)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            row, place = np.nonzero(large)
            edges = np.searchsorted(row, np.arange(len(own) + 1)).tolist()
            place, value = place.astype("<u2"), values[large].astype("<u4")
            for i, k in enumerate(own.tolist()):
                a, b = edges[i], edges[i + 1]
                blocks[k] = b"".join(
                    (HEAD.pack(n, b - a, width, int(least[k])), packed[i].tobytes(), place[a:b].tobytes(), value[a:b].tobytes())
                )
        out.extend(blocks)
    return out


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at `starts` in `data`."""
    heads = [HEAD.unpack_from(data, a) for a in starts]
    sizes = np.array([h[0] for h in heads], np.int64)
    first = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), np.uint32)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (n, _, width, _) in enumerate(heads):
        groups.setdefault((n, width), []).append(i)
    for (n, width), own in groups.items():
        n_bytes = -(-n * width // 8)
        values = np.zeros((len(own), n), np.int64)
        if width:
            raw = np.frombuffer(b"".join([data[starts[i] + HEAD.size : starts[i] + HEAD.size + n_bytes] for i in own]), np.uint8)
            bits = np.unpackbits(raw.reshape(len(own), n_bytes), axis=1, count=n * width, bitorder="little")
            values = bits.reshape(len(own), n, width) @ (1 << np.arange(width))
        for row, i in zip(values, own):
            _, n_large, _, least = heads[i]
            at = starts[i] + HEAD.size + n_bytes
            row[np.frombuffer(data, "<u2", n_large, at)] = np.frombuffer(data, "<u4", n_large, at + 2 * n_large)
            ids[first[i] : first[i] + n] = row + least
    return ids


MANIFEST = "shard int, file string, n_docs long, n_ids long, n_bytes long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


@frees_memory
def _write_rows(batches: Iterator[pa.RecordBatch], folder: str, path: str) -> Iterator[pa.RecordBatch]:
    """Rows of a task in order -> one file, one row about it."""
    task = TaskContext.get()
    name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
    out, held, doc_ids, sizes = None, np.zeros(0, np.int64), [], []
    block_starts: list[int] = []
    at = 0

    def write(pieces: list[bytes]) -> None:
        nonlocal at
        for p in pieces:
            block_starts.append(at)
            at += len(p)
        out.write(b"".join(pieces))

    for batch in batches:
        for block in text_blocks(batch, "text", ENCODED_BYTES):
            if out is None:
                store, root = _place(folder)
                out = store.open_output_stream(f"{root}/{name}")
                out.write(MAGIC)
                at = len(MAGIC)
            ids, offsets = encoder(path).encode(block.batch["text"])
            doc_ids.append(block.batch["doc_id"])
            sizes.append(np.diff(offsets))
            held = np.concatenate([held, ids])
            whole = len(held) // BLOCK * BLOCK
            for a in range(0, whole, BLOCKS_AT_ONCE * BLOCK):
                write(encode_blocks(held[a : min(whole, a + BLOCKS_AT_ONCE * BLOCK)]))
            held = held[whole:]
    encoder(path).forget()
    if out is None:
        return
    write(encode_blocks(held))
    docs = pa.chunked_array(doc_ids).combine_chunks()
    starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
    index = at
    out.write(np.array([*block_starts, at], "<u8").tobytes())
    out.write(docs.fill_null(0).to_numpy().astype("<i8").tobytes())
    out.write(docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
    out.write(starts.tobytes())
    out.write(FOOTER.pack(len(block_starts), len(docs), index, MAGIC))
    size = out.tell()
    out.close()
    yield pa.RecordBatch.from_pylist(
        [{"shard": task.partitionId(), "file": name, "n_docs": len(docs), "n_ids": int(starts[-1]), "n_bytes": size}],
        pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
    )


def write_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, text: str = "text", doc_id: str = "doc_id"
) -> tuple[DataFrame, str]:
    """Files of all ids in ascending order of doc_id, below `folder` (by default a new one in the shared folder), which
    every executor reaches; and a table of them: shard, file, n_docs, n_ids, n_bytes and start, the ids before it."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    store, root = _place(folder)
    store.create_dir(root, recursive=True)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_key"))
    ordered = rows.repartitionByRange("doc_id", "_key").sortWithinPartitions("doc_id", "_key").select("doc_id", "text")
    files = stage(ordered.mapInArrow(lambda batches: _write_rows(batches, folder, tokenizer), MANIFEST), "manifest")
    # One row for each file: small enough for one window.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))), folder


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, folder: str, name: str) -> None:
        store, root = _place(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        n_blocks, n_docs, index, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        data = self.file.read_at(size - FOOTER.size - index, index)
        self.blocks = np.frombuffer(data, "<u8", n_blocks + 1).astype(np.int64)
        at = 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.missing = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at + 9 * n_docs).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of the documents from place `first` to before `last`, one after the other."""
        a, b = int(self.starts[first]), int(self.starts[last])
        if a == b:
            return np.zeros(0, np.uint32)
        low, high = a // BLOCK, -(-b // BLOCK)
        base = int(self.blocks[low])
        data = self.file.read_at(int(self.blocks[high]) - base, base)
        return decode_blocks(data, (self.blocks[low:high] - base).tolist())[a - low * BLOCK : b - low * BLOCK]


ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _read_rows(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file = TokenFile(folder, row["file"])
            n, first = len(file.doc_ids), 0
            while first < n:  # some documents at a time
                last = int(np.searchsorted(file.starts, file.starts[first] + BLOCKS_AT_ONCE * BLOCK))
                last = min(n, max(last, first + 1))
                ids = file.ids(first, last).astype("<u4").tobytes()
                starts = file.starts[first : last + 1]
                edges = (4 * (starts - starts[0])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids[first:last], mask=file.missing[first:last]), pa.array(starts[:-1] + row["start"]),
                        pa.array(np.diff(starts)), pa.array([ids[a:b] for a, b in zip(edges, edges[1:])], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                first = last
            file.file.close()


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit numbers)."""
    dealt = files.select("file", "start").repartition(max(1, files.count()))
    return dealt.mapInArrow(lambda batches: _read_rows(batches, folder), ROWS)
