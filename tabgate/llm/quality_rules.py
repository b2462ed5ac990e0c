"""Quality rules over documents: rules within a text, and lines that too many documents of a host share.

A line is normalised (words in lower case A-Z, runs of digits as one 0, joined by one space) and hashed. For each host
and line the distinct documents that hold it are counted, a group of copies once; a line is removed when the count is
above ``min_contexts`` and above ``host_per_mille`` of the host's documents. A document is rejected when the lines left
hold less than ``least_left_per_mille`` of its words.

Copies are told in two steps. Documents with the same lines are one. The lines that stand in enough of these are set
apart, and what a document holds besides them tells near copies: documents of a host are one group if two min-hashes
of the five-word shingles of their other lines agree in any of N_BANDS bands. So notices that stand together can't make
documents alike, and an edited copy is still like the others in the line that was edited. Documents of nothing but
lines set apart are one only if these are the same.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows
are documents each; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgate.llm.arrow_text import TextBlock, frees_memory, mixed, shingle_hashes, text_blocks
from tabgate.llm.tables import NO_ID, bounded_batches, row_key, stage

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
DIGITS = re.compile(rb"[0-9]+")
#: Bands of two min-hashes of 32 bits for each line.
N_BANDS = 8
FACTORS = mixed(np.arange(1, 2 * N_BANDS + 1, dtype=np.uint64)) | np.uint64(1)
#: Keys of documents are sent to all executors only up to this many rows of two to four numbers each.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Per thousand where a share is meant, so that both engines compare whole numbers."""

    min_words: int = 10
    repeat_percent: int = 20
    min_contexts: int = 20
    host_per_mille: int = 2
    least_left_per_mille: int = 300


def line_hash(line: bytes) -> int:
    """60 bits of the MD5 of the normalised line; 0 if it has no word."""
    words = line.lower().split()
    return int(hashlib.md5(DIGITS.sub(b"0", b" ".join(words))).hexdigest()[:15], 16) if words else 0


def repeated_words(block: TextBlock, width: int = 5) -> np.ndarray:
    """For each text, how many words stand in a window of `width` words found twice or more in it."""
    n_words = len(block.starts)
    grams = shingle_hashes(block.word_hashes(), width)
    text_of = block.text_of_word
    inside = np.flatnonzero(text_of[: len(grams)] == text_of[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    keys = mixed(grams[inside] + text_of[inside].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = inside[twice]
    steps = np.zeros(n_words + width + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    sums = np.zeros(n_words + 1, np.int64)
    np.cumsum(np.cumsum(steps)[:n_words] > 0, out=sums[1:])
    return np.diff(sums[block.word_offsets])


def _base(block: TextBlock, limits: Limits) -> dict[str, np.ndarray]:
    inside = np.zeros(len(block.buf) + 1, np.int8)
    np.add.at(inside, block.starts, 1)
    np.add.at(inside, block.ends, -1)
    n_words = block.n_words.astype(np.int64)
    repeated = repeated_words(block)
    return {
        "n_words": n_words,
        "word_chars": block.counts((np.cumsum(inside)[:-1] > 0) & ((block.buf & 0xC0) != 0x80)),
        "n_symbols": block.counts(SYMBOLS[block.buf]),
        "n_repeat_words": repeated,
        "base_failed": (n_words < limits.min_words) | (100 * repeated > limits.repeat_percent * n_words),
    }


FACTS = (
    "_row long, doc_id long, _key long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, lines array<long>, line_words array<int>, marks binary"
)


def line_marks(block: TextBlock, sizes: list[int], hashes: list[int], width: int = 5) -> np.ndarray:
    """For each line the min-hashes of its shingles; `sizes` are the words of all lines with words, in order."""
    n = np.array(sizes, np.int64)
    starts = np.cumsum(n) - n
    marks = (np.array(hashes, np.uint64)[:, None] * FACTORS >> np.uint64(32)).astype(np.uint32)
    long = np.flatnonzero(n >= width)
    if len(long):
        counts = n[long] - width + 1
        firsts = np.cumsum(counts) - counts
        grams = shingle_hashes(block.word_hashes(lower=True), width)
        grams = grams[np.repeat(starts[long] - firsts, counts) + np.arange(counts.sum())]
        for k, factor in enumerate(FACTORS):
            marks[long, k] = np.minimum.reduceat((grams * factor >> np.uint64(32)).astype(np.uint32), firsts)
    return marks


@frees_memory
def _facts(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for block in text_blocks(batch, "text"):
            n, base = len(block), _base(block, limits)
            lines, words, doubled, firsts = [], [], [], []
            all_sizes: list[int] = []
            all_hashes: list[int] = []
            for text in block.texts():
                seen: set[bytes] = set()
                hashes: dict[int, int] = {}  # with the words of all lines of that hash
                first: list[int] = []  # places of these lines in the block
                n_lines = 0
                for line in text.split(b"\n"):
                    if h := line_hash(line):
                        n_lines += 1
                        seen.add(line)
                        size = len(line.split())
                        if h not in hashes:
                            first.append(len(all_sizes))
                        hashes[h] = hashes.get(h, 0) + size
                        all_sizes.append(size)
                        all_hashes.append(h)
                doubled.append(n_lines - len(seen))
                lines.append(list(hashes))
                words.append(list(hashes.values()))
                firsts.append(first)
            marks = line_marks(block, all_sizes, all_hashes)
            columns = {
                "_row": np.arange(row, row + n), "doc_id": block.batch["doc_id"], "_key": block.batch["_key"],
                "host": block.batch["host"], **base, "n_dup_lines": doubled, "lines": pa.array(lines, pa.list_(pa.int64())),
                "line_words": pa.array(words, pa.list_(pa.int32())), "marks": pa.array([marks[x].tobytes() for x in firsts], pa.binary()),
            }
            row += n
            names = [x.split()[0] for x in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names)


@frees_memory
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with lines set apart: what tells near copies by their other lines."""
    turns = np.arange(1, N_BANDS + 1, dtype=np.uint64)
    for batch in batches:
        bands = []
        for whole, lines, common, raw in zip(*[batch[c].to_pylist() for c in ("whole", "lines", "common", "marks")]):
            common = set(common)
            other = [i for i, h in enumerate(lines) if h not in common]
            if other:
                least = np.frombuffer(raw, np.uint32).reshape(-1, 2 * N_BANDS)[other].min(axis=0)
                bands.append(mixed(mixed(least.view(np.uint64)) + turns).view(np.int64).tolist())
            else:
                bands.append([whole])
        yield pa.RecordBatch.from_arrays(
            [batch["host"], batch["whole"], batch["common"], pa.array(bands, pa.list_(pa.int64()))], ["host", "whole", "common", "bands"]
        )


def _enough(counted: DataFrame, sizes: DataFrame, limits: Limits) -> DataFrame:
    """(host, line, n) -> the lines that stand in enough documents."""
    return (
        counted.filter(F.col("n") > limits.min_contexts).join(sizes, "host")
        .filter(1000 * F.col("n") > limits.host_per_mille * F.col("n_host")).select("host", "line")
    )


def removed_lines(facts: DataFrame, limits: Limits) -> DataFrame:
    """(host, line) of the lines that too many documents of a host share, a group of copies counted once."""
    sizes = facts.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    whole = F.xxhash64(F.array_sort("lines")).alias("whole")
    texts = facts.filter(F.size("lines") > 0).select("host", whole, "lines", "marks").dropDuplicates(["host", "whole"])
    texts = stage(texts, "distinct-lines")
    each = texts.select("host", "whole", F.explode("lines").alias("line"))
    common = stage(_enough(each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")), sizes, limits), "common-lines")
    held = each.join(common, ["host", "line"]).groupBy("host", "whole").agg(F.collect_list("line").alias("common"))
    banded = texts.join(held, ["host", "whole"]).select("host", "whole", "lines", "marks", "common")
    banded = stage(banded.mapInArrow(_bands, "host string, whole long, common array<long>, bands array<long>"), "line-bands")
    meets = banded.select("host", "whole", F.explode("bands").alias("band"))
    least = meets.groupBy("host", "band").agg(F.min("whole").alias("group"))
    groups = meets.join(least, ["host", "band"]).groupBy("host", "whole").agg(F.min("group").alias("group"))
    counted = (
        banded.select("host", "whole", "common").join(groups, ["host", "whole"])
        .select("host", "group", F.explode("common").alias("line")).distinct()
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    )
    return stage(_enough(counted, sizes, limits), "removed-lines")


def _judged(docs: DataFrame, text: str, doc_id: str, host: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """One row per document, with `host` and `kept`; and (_row, host, line, words) of the lines removed from each."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), row_key(text, doc_id)[1], host_name(host).alias("host"), F.col(text).alias("text"),
    )
    facts = stage(rows.mapInArrow(lambda batches: _facts(batches, limits), FACTS), "line-facts")
    cut = (
        facts.select("_row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
        .select("_row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
        .join(removed_lines(facts, limits), ["host", "line"])
    )
    lost = cut.groupBy("_row").agg(F.sum("words").cast("long").alias("lost"))
    judged = facts.drop("lines", "line_words", "marks").join(lost, "_row", "left")
    lost_words = F.coalesce("lost", F.lit(0).cast("long"))
    depleted = 1000 * (F.col("n_words") - lost_words) < limits.least_left_per_mille * F.col("n_words")
    verdicts = judged.select(
        "_row", "host", "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "_key", "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), lost_words.alias("n_removed_words"),
    )
    return verdicts, cut


def host_name(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("\0null"))


def quality_verdicts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """One row per document: what the base rules count, the words in removed lines, and the verdict `kept`.

    `_id` and `_key` (see `row_key`) stand for the row; equal rows are told alike.
    """
    return _judged(docs, text, doc_id, host, limits)[0].drop("_row", "host")


def sent_if_few(keys: DataFrame) -> DataFrame:
    """Stored rows of a few numbers, for a join with whole texts: sent to all executors if there are few of them."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def without(docs: DataFrame, rejected: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose (`_id`, `_key`) is not among the rejected ones.

    The rejected keys go to all executors only when they are counted to be few; otherwise both sides are shuffled.
    """
    rejected = stage(rejected.select(F.col("_id").alias("_gone_id"), F.col("_key").alias("_gone_key")), "rejected")
    rejected = sent_if_few(rejected)
    ident, key = row_key(text, doc_id)
    return docs.join(rejected, (ident == F.col("_gone_id")) & (key == F.col("_gone_key")), "left_anti")


def keep_good(docs: DataFrame, **names: str) -> DataFrame:
    """The documents that pass, with all their columns."""
    verdicts = quality_verdicts(docs, **names)
    return without(docs, verdicts.filter(~F.col("kept")), names.get("text", "text"), names.get("doc_id", "doc_id"))


@frees_memory
def _without_lines(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, texts = batch.schema.get_field_index(text), []
        for block in text_blocks(batch, text):
            for whole, cut in zip(block.texts(), block.batch["_cut"].to_pylist()):
                gone = set(cut)
                texts.append(b"\n".join(x for x in whole.split(b"\n") if line_hash(x) not in gone).decode())
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).drop_columns(["_cut"])


def clean(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """The documents that pass, with all their columns, their removed lines cut out of the text.

    The lines left stand in their order, byte for byte. Documents that lose none don't go through Python. Rows equal in
    id, text and host get the same result; in rows equal but for the host, that of each host.
    """
    verdicts, cut = _judged(docs, text, doc_id, host, limits)
    verdicts = stage(verdicts.select("_row", "_id", "_key", "host", "kept", "n_removed_words"), "verdicts")
    ident, key = row_key(text, doc_id)
    same = lambda x: (ident == x["_gone_id"]) & (key.eqNullSafe(x["_gone_key"])) & (host_name(host) == x["_gone_host"])
    renamed = [F.col(c).alias(f"_gone{c if c[0] == '_' else '_' + c}") for c in ("_id", "_key", "host")]
    # Equal rows have equal cuts: one of them stands for all.
    losing = verdicts.filter("kept AND n_removed_words > 0").groupBy("_id", "_key", "host").agg(F.min("_row").alias("_row"))
    cuts = (
        cut.select("_row", "line").join(losing, "_row").groupBy(*renamed).agg(F.collect_set("line").alias("_cut"))
    )
    cuts = stage(cuts, "cuts")
    other = stage(verdicts.filter("NOT kept OR n_removed_words > 0").select(*renamed).distinct(), "rejected-or-cut")
    whole = docs.join(sent_if_few(other), same(other), "left_anti")
    shortened = docs.join(cuts, same(cuts)).select(*[docs[c] for c in docs.columns], "_cut")
    return whole.unionByName(shortened.mapInArrow(lambda b: _without_lines(b, text), docs.schema))
