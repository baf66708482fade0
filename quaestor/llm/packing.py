"""Packing by vector bins: tokens, segments and loss-bearing tokens at once.

Every piece of an example asks for three things of a sequence: tokens, one
segment (attention is cut between segments) and tokens that bear loss. A
sequence is filled one piece at a time with the piece whose demand has the
largest weighted dot product with what the sequence has left, so a sequence
that runs short of segments draws long pieces and one that runs short of
tokens draws short ones (the dot-product heuristic of vector bin packing).

Pieces of equal demand are one class, so a placement costs one product over the
classes and not over the pieces. A task packs what it has read in rounds of
bounded size and hands what is left to its next round; nothing is shuffled, and
a task that is run again gives the same sequences.

`pack_documents` cuts long texts: full sequences first, the rest by the
heuristic, and what still gapes is filled by cutting a piece. A sequence that
closes early (no segment left, or the last of a task) is cut back to a power of
two and the rest goes on, so no sequence is padded.

`pack_examples` packs instruction data, whose examples are never cut. One that
exceeds a limit by itself gets no sequence (null).

Null and empty texts are one end id. Repeated rows are packed as often as they
occur; a null id is carried like any other. An empty table gives no rows. Only
the id and text columns are read, whatever else the table has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.textops import blocks
from quaestor.llm.tokens import END_ID, encoder

#: Tokens of documents, or number of examples, that a task holds at a time.
ROUND_TOKENS = 1_000_000
ROUND_EXAMPLES = 20_000

_SEQUENCES_PER_TASK = 33  # bits


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. The first token of a segment bears no loss."""

    tokens: int = 1024
    segments: int = 32
    loss: int = 1023


class Classes:
    """Pieces by demand, and the choice of the next one for a sequence."""

    def __init__(self, demand: np.ndarray, limits: Limits):
        self.room = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.demand = demand.astype(np.int64)
        self.share = demand / np.maximum(self.room, 1)
        self.items: list[list] = [[] for _ in demand]
        self.count = np.zeros(len(demand), np.int64)

    def add(self, which: int, item) -> None:
        self.items[which].append(item)
        self.count[which] += 1

    def take(self, which: int):
        self.count[which] -= 1
        return self.items[which].pop()

    def weights(self) -> np.ndarray:
        """Scarce things weigh more: the mean demand of what waits."""
        waiting = self.count.sum()
        return self.count @ self.share / waiting if waiting else np.ones(3)

    def best(self, left: np.ndarray, weights: np.ndarray) -> int:
        """The class with the largest dot product that fits; -1 if none does."""
        fits = (self.count > 0) & (self.demand <= left).all(axis=1)
        if not fits.any():
            return -1
        score = self.share @ (weights * left / np.maximum(self.room, 1))
        return int(np.argmax(np.where(fits, score, -1.0)))


class DocumentPacker:
    """Cuts and packs the pieces of one task."""

    def __init__(self, limits: Limits):
        self.limits = limits
        lengths = np.arange(limits.tokens + 1)
        demand = np.stack([lengths, np.ones_like(lengths), np.maximum(lengths - 1, 0)], 1)
        self.full = min(limits.tokens, limits.loss + 1)
        self.pool = Classes(demand, limits)
        self.sequences = 0
        self.waiting = 0

    def add(self, document: int, tokens: int) -> list[tuple]:
        """Take a document; give the full sequences that are its alone."""
        out, start = [], 0
        while tokens - start >= self.full:
            # A piece shorter than a sequence would be padded unless it is a power of two.
            length = _power_of_two(self.full) if self.full < self.limits.tokens else self.full
            out.append((document, start, length, self._next(), 0))
            start += length
        if start < tokens:
            self.pool.add(tokens - start, (document, start))
            self.waiting += tokens - start
        return out

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def pack(self, last: bool) -> list[tuple]:
        """Fill sequences from the pool; unless `last`, the rest stays there."""
        out, weights = [], self.pool.weights()
        while self.waiting >= (1 if last else self.limits.tokens):
            out += self._sequence(weights)
        return out

    def _sequence(self, weights: np.ndarray) -> list[tuple]:
        limits, pool = self.limits, self.pool
        left = np.array([limits.tokens, limits.segments, limits.loss])
        chosen: list[tuple[int, int, int]] = []
        while left[0] > 0 and left[1] > 0:
            length = pool.best(left, weights)
            if length < 0:
                # Nothing fits as it is: cut the longest piece to the gap.
                longer = np.flatnonzero(pool.count)
                gap = int(min(left[0], left[2] + 1))
                if not len(longer) or gap < 1:
                    break
                document, start = pool.take(int(longer[-1]))
                pool.add(int(longer[-1]) - gap, (document, start + gap))
                length = gap
            else:
                document, start = pool.take(length)
            chosen.append((document, start, length))
            left -= (length, 1, length - 1)
        filled = limits.tokens - int(left[0])
        keep = filled if filled == limits.tokens else _power_of_two(filled)
        number, offset, out = self._next(), 0, []
        for document, start, length in chosen:
            here = min(length, keep - offset)
            if here > 0:
                out.append((document, start, here, number, offset))
                offset += here
            if here < length:
                pool.add(length - max(here, 0), (document, start + max(here, 0)))
        self.waiting -= keep
        return out


def _power_of_two(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def pack_documents(
    docs: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """Pieces of all documents: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _SEQUENCES_PER_TASK
        packer, encode = DocumentPacker(limits), encoder(vocabulary)
        ids: dict[int, np.ndarray] = {}
        keys: dict[int, object] = {}
        seen = held = 0
        id_type = None

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
            long = lambda i: pa.array([p[i] for p in pieces], pa.int64())
            columns = [
                pa.array([keys[p[0]] for p in pieces], id_type),
                long(1),
                long(2),
                pa.array(crc, pa.int64()),
                pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
                pa.array([base + p[3] for p in pieces], pa.int64()),
                long(4),
            ]
            return pa.RecordBatch.from_arrays(columns, NAMES)

        for batch in batches:
            id_type = batch.column(0).type
            for block in blocks(batch.column(1)):
                pieces = []
                for key, own_ids in zip(batch.column(0)[block.rows].to_pylist(), encode.encode(block)):
                    keys[seen], ids[seen] = key, np.append(own_ids, np.int32(END_ID))
                    held += len(ids[seen])
                    pieces += packer.add(seen, len(ids[seen]))
                    seen += 1
                if held >= ROUND_TOKENS:
                    pieces += packer.pack(last=False)
                    if pieces:
                        yield rows(pieces)
                    open_now = {d for items in packer.pool.items for d, _ in items}
                    ids = {d: ids[d] for d in open_now}
                    keys = {d: keys[d] for d in open_now}
                    held = sum(map(len, ids.values()))
                elif pieces:
                    yield rows(pieces)
        if pieces := packer.pack(last=True):
            yield rows(pieces)

    schema = (
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint"
    )
    return own.mapInArrow(task, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_examples(
    examples: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "example_id",
    tokens_col: str = "tokens",
    loss_col: str = "loss_tokens",
) -> DataFrame:
    """Place whole examples: (example_id, tokens, loss_tokens, sequence_id, offset).

    A null count is 0. Examples over a limit have neither sequence nor offset.
    """
    own = examples.select(
        F.col(id_col).alias("example_id"),
        F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("tokens"),
        F.coalesce(F.col(loss_col).cast("long"), F.lit(0)).alias("loss_tokens"),
    )
    kind = own.schema["example_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _SEQUENCES_PER_TASK
        for batch in batches:
            for at in range(0, len(batch), ROUND_EXAMPLES):
                part = batch.slice(at, ROUND_EXAMPLES)
                tokens, loss = part.column(1).to_numpy(), part.column(2).to_numpy()
                bins, offsets = place(tokens, loss, limits)
                placed = bins >= 0
                out = [
                    part.column(0),
                    part.column(1),
                    part.column(2),
                    pa.array(number + bins, pa.int64(), mask=~placed),
                    pa.array(offsets, pa.int64(), mask=~placed),
                ]
                number += int(bins.max(initial=-1)) + 1
                names = ["example_id", "tokens", "loss_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = (
        f"example_id {kind}, tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"
    )
    return own.mapInArrow(task, schema)


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each example of one round; -1 if it exceeds a limit."""
    demand, which = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    demand = np.insert(demand, 1, 1, axis=1)
    bins = np.full(len(tokens), -1, np.int64)
    offsets = np.full(len(tokens), -1, np.int64)
    room = np.array([limits.tokens, limits.segments, limits.loss])
    pool = Classes(demand, limits)
    for i, c in enumerate(which.ravel().tolist()):
        if (demand[c] <= room).all():
            pool.add(c, i)
    weights, number = pool.weights(), 0
    while pool.count.any():
        left, offset = room.copy(), 0
        while (best := pool.best(left, weights)) >= 0:
            i = pool.take(best)
            bins[i], offsets[i] = number, offset
            offset += int(demand[best][0])
            left = left - demand[best]
        number += 1
    return bins, offsets
