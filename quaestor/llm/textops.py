"""Array operations on the texts of an Arrow batch.

The operators of this package read texts in `mapInArrow` tasks. A batch is cut
into blocks of about a quarter of a megabyte; a block's UTF-8 bytes are one array with the
documents' offsets beside it, so splitting, hashing and counting run over all
documents of a block at once. A longer text makes a block of its own, and is
read whole. Nothing here keeps more than one block.

Null texts count as empty. Words are told apart by 64-bit hashes: two different
words of a corpus with a billion distinct ones meet with a chance below 3 %,
two words of one document with one below 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Random 64-bit values for bytes and for places in a window.
BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
PLACE_KEYS = mix(np.arange(1000, 1064, dtype=np.uint64) * _ODD) | np.uint64(1)

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, m, m², … with an odd m, as far as n."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, BLOCK_BYTES), np.uint64(0xD6E8FEB86659FD93), np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


class Block:
    """Some documents of a batch: `data` their bytes, `offsets` where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def rows(self) -> slice:
        return slice(self.first, self.first + len(self))

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the longest runs of bytes with `inside`."""
        n = len(inside)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        here = np.zeros(n + 1, bool)
        here[:n] = inside
        starts = np.flatnonzero(here & (~before | first))
        ends = np.flatnonzero(before & (~here | first))
        return starts, ends, self.document_of(starts)

    def document_of(self, places: np.ndarray) -> np.ndarray:
        """Documents of ascending byte positions."""
        counts = np.diff(np.searchsorted(places, self.offsets))
        return np.repeat(np.arange(len(self)), counts)

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document have the flag."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string column in blocks of about `size` bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        own = offsets[at : end + 1]
        yield Block(at, data[own[0] : own[-1]], own - own[0])
        at = end


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right"))
        end = max(end, at + 1)
        low, high = int(starts[at]), int(ends[end - 1])
        power = powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_KEYS[data[low:high]] * power[:-1], out=total[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        # The sum of a run holds the power of its start; scaling it up to a
        # power that all runs share makes equal runs equal.
        out[at:end] = (total[e] - total[s]) * power[high - low - s]
        out[at:end] = mix(_level(out[at:end], high - low, power))
        at = end
    return out


def _level(values: np.ndarray, top: int, power: np.ndarray) -> np.ndarray:
    """Divide by the shared power, so that hashes agree between blocks."""
    inverse = pow(int(power[top]), -1, 1 << 64)
    return values * np.uint64(inverse)


def words(block: Block, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word `[^\\x20\\x09-\\x0D]+`, in reading order."""
    starts, ends, document = block.runs(~ASCII_SPACE[block.data])
    data = LOWER[block.data] if lower else block.data
    return hash_runs(data, starts, ends), document


def windows(hashes: np.ndarray, document: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `k` words in a row within a document, and where each begins."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * PLACE_KEYS[j]
    inside = document[:n] == document[k - 1 :]
    return mix(total)[inside], np.flatnonzero(inside)


def map_blocks(batches: Iterator[pa.RecordBatch], text: int, make) -> Iterator[pa.RecordBatch]:
    """Apply `make(batch, block)` to each block of each batch.

    A worker serves task after task, so what a batch leaves free goes back to
    the system before the next one.
    """
    for batch in batches:
        for block in blocks(batch.column(text)):
            out = make(batch, block)
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()
