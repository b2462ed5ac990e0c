"""Whole texts of Arrow batches as byte buffers with word and line positions, in bounded blocks.

Words are runs of bytes outside x20 and x09-x0D; as all of these are ASCII, working on UTF-8 bytes and on code points
gives the same words. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: An odd base; sums of powers modulo 2**64 identify byte strings, and its inverse shifts them to a common place.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def frees_memory(rows: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """For functions over a task's batches: workers outlive tasks, so what they keep between blocks goes at the end."""

    @wraps(rows)
    def run(*args, **named) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(*args, **named)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()

    return run


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: each half is the other one times a constant
            step = np.uint64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Each byte stands for a 64-bit value of its own, so that short strings of near bytes don't cancel out.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i] stands for buf[i:j], up to the factor BASE ** i."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * powers(BASE, len(buf)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]; equal bytes give equal hashes, wherever they stand."""
    return (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts]


@dataclass
class TextBlock:
    """Consecutive rows of a batch: their texts side by side in one byte buffer."""

    batch: pa.RecordBatch
    buf: np.ndarray
    offsets: np.ndarray  # of each text, and the end of the last

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def texts(self) -> Iterator[bytes]:
        view = self.buf.tobytes()
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            yield view[a:b]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(self.buf) + 2, bool)
        inside[1:-1] = ~SPACE[self.buf]
        cut = np.zeros(len(self.buf) + 1, bool)  # a word ends where its text ends
        cut[self.offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        return starts, ends

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """The words of text i are those from word_offsets[i] to word_offsets[i + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return mixed(span_hashes(prefix_sums(LOWER[self.buf] if lower else self.buf), self.starts, self.ends))

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each `width` words in a row; the caller leaves out those that cross a text's end."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(BASE) + words[k : k + n]
    return mixed(h)


def text_blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """The rows of a batch, in blocks of about `block_bytes` bytes of text."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.type not in (pa.string(), pa.binary()):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, b"" if texts.type == pa.binary() else "")
    if not len(texts):
        return
    _, offsets_buffer, data = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1)
        yield TextBlock(batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end
