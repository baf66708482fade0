"""Spelling variants: words one edit apart, found through Bloom filters.

The words of all texts are counted. Each word of the vocabulary then generates
the words that one edit makes of it, as hashes: every letter deleted, and every
letter replaced by each later letter of the alphabet in use. A pair that differs
by an insertion is a deletion for its longer word, and one that differs by a
replacement is generated by the word with the earlier letter, so each pair comes
up once. Generated hashes probe the filter of their length; only what a filter
lets through is written out as a word and moves to a join with the vocabulary,
which drops the false positives.

A filter is blocked: one 64-bit slot holds the five bits of a word, four bits
are reserved per letter. Filters have a bounded size whatever the vocabulary: a
round broadcasts at most ROUND_SLOTS slots (32 MB), as many lengths as fit, and
a length that doesn't fit is cut into parts by hash. A word takes part in the
rounds of its own length and the one below. Words of 32 letters and more share
a filter.

A form is the near word of largest count, if that is ten times the word's own or
more; so a chain of forms has at most as many links as the largest count has
digits, and its end is found by doubling that often.

A null text has no words; a null id is written as nothing. Repeated rows count
each. Without words of two occurrences there are no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.stored import stored
from quaestor.llm.textops import BYTE_KEYS, LOWER, Block, blocks, hash_runs, mix, powers

#: Fixed values of the definition.
LEAST_LETTERS, LEAST_COUNT, DAMAGED, RATIO = 7, 2, 31, 10

ROUND_SLOTS = 1 << 22
_TOP = 32  # this length and longer ones share a filter
_SLOT_LETTERS = 16  # four bits per letter
_LEAST_SLOTS = 64

_COUNT_BYTES = 1 << 20
_LONG = 64  # bytes; longer runs are hashed one by one

def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1)
    return rows


_CRC = _crc_table()
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LATIN = 0xC3  # the first byte of each letter from U+00C0 to U+00FF


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes after a prefix, whose own CRC-32 is given."""
    out = np.empty(len(starts), np.uint32)
    long = np.flatnonzero(ends - starts > _LONG)
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(prefixes[i]))
    order = np.argsort(starts - ends, kind="stable")[len(long) :]
    sizes, at = (ends - starts)[order], starts[order]
    state = ~prefixes[order]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = len(sizes) - int(np.searchsorted(sizes[::-1], j, side="right"))
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of bytes as strings."""
    sizes = ends - starts
    offsets = np.append(0, np.cumsum(sizes))
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[places])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), buffers).cast(pa.string())


def _block_counts(ids: pa.Array, block: Block) -> pa.RecordBatch:
    """(word, n) of a block's documents, after damage; a word may have several rows."""
    low = LOWER[block.data]
    lead = block.data == _LATIN
    inside = _ASCII_LETTER[block.data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, document = block.runs(inside)
    leads = np.append(0, np.cumsum(lead))
    letters = ends - starts - (leads[ends] - leads[starts])
    some = letters >= LEAST_LETTERS
    starts, ends, document, letters = starts[some], ends[some], document[some], letters[some]
    prefixes = np.array([zlib.crc32(f"{i}:".encode()) for i in ids.to_pylist()], np.uint32)
    sums = _checksums(low, starts, ends, prefixes[document])
    hit = sums % DAMAGED == 0
    _, first, n = np.unique(hash_runs(low, starts[~hit], ends[~hit]), return_index=True, return_counts=True)
    words = _gathered(low, starts[~hit][first], ends[~hit][first])
    damaged = []
    for i in np.flatnonzero(hit & (letters > LEAST_LETTERS)).tolist():
        word = low[starts[i] : ends[i]].tobytes().decode()
        at = int(sums[i]) % len(word)
        damaged.append(word[:at] + word[at + 1 :])
    columns = [
        pa.concat_arrays([words, pa.array(damaged, pa.string())]),
        pa.array(np.append(n, np.ones(len(damaged), np.int64)).astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word of all texts that occurs often enough."""
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), _COUNT_BYTES):
                yield _block_counts(batch.column(0)[block.rows], block)

    counted = own.mapInArrow(task, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _lengths(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Letters of words of one length as a matrix, and which words they are."""
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        joined = "".join([texts[i] for i in rows]).encode("latin-1")
        yield np.frombuffer(joined, np.uint8).reshape(len(rows), size), rows


def _finish(raw: np.ndarray, length: int) -> np.ndarray:
    return mix(raw + BYTE_KEYS[:1] * np.uint64(length))


def _hashes(matrix: np.ndarray) -> np.ndarray:
    """A hash per row that edits can be worked out from: powers times letters, summed."""
    length = matrix.shape[1]
    return _finish((BYTE_KEYS[matrix] * powers(length)).sum(axis=1, dtype=np.uint64), length)


@dataclass(frozen=True)
class Shard:
    """The filter of some words of a length: `part` of `parts` by hash, `slots` from `base` on."""

    length: int
    part: int
    parts: int
    slots: int
    base: int

    def slot_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes belong here, and their slots."""
        part = ((hashes >> np.uint64(30)) & np.uint64(1023)) * np.uint64(self.parts) >> np.uint64(10)
        own = np.flatnonzero(part == self.part) if self.parts > 1 else np.arange(len(hashes))
        slot = (hashes[own] >> np.uint64(40)) & np.uint64(self.slots - 1)
        return own, slot.astype(np.int64) + self.base


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(6 * k)) & np.uint64(63) for k in range(5)]


def rounds_of(letters: dict[int, int], round_slots: int = ROUND_SLOTS) -> list[list[Shard]]:
    """Shards for the number of letters of each length's words, packed into rounds."""
    rounds, used = [], round_slots
    for length, total in sorted(letters.items()):
        slots = 1 << max(_LEAST_SLOTS, total // _SLOT_LETTERS).bit_length()
        parts = min(1024, -(-slots // round_slots))
        slots = min(slots, round_slots)
        for part in range(parts):
            if used + slots > round_slots:
                rounds.append([])
                used = 0
            rounds[-1].append(Shard(length, part, parts, slots, used))
            used += slots
    return rounds


def _filter(words: DataFrame, shards: list[Shard]) -> np.ndarray:
    """The slots of a round, at most ROUND_SLOTS; `words` has (word, class)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for matrix, _ in _lengths(batch.column(0)):
                hashes = _hashes(matrix)
                for shard in shards:
                    if shard.length == min(matrix.shape[1], _TOP):
                        own, slot = shard.slot_of(hashes)
                        mask = np.zeros(len(own), np.uint64)
                        for bit in _bits(hashes[own]):
                            mask |= np.uint64(1) << bit
                        columns = [pa.array(slot), pa.array(mask.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["slot", "mask"])

    own = words.filter(F.col("class").isin(sorted({s.length for s in shards}))).select("word")
    marked = own.mapInArrow(task, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    rows = marked.toArrow()
    out = np.zeros(max(s.base + s.slots for s in shards), np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


#: Generated words that a task looks up at once.
_AT_ONCE = 1 << 16


class _Prober:
    def __init__(self, slots: np.ndarray, shards: list[Shard], alphabet: np.ndarray):
        self.slots, self.alphabet = slots, alphabet
        self.shards: dict[int, list[Shard]] = {}
        for shard in shards:
            self.shards.setdefault(shard.length, []).append(shard)

    def _held(self, raw: np.ndarray, length: int) -> np.ndarray:
        """Places of the raw hashes that the filter may hold."""
        hashes, out = _finish(raw, length), []
        for shard in self.shards[min(length, _TOP)]:
            own, slot = shard.slot_of(hashes)
            found = self.slots[slot]
            for k in range(5):
                bit = (hashes[own] >> np.uint64(6 * k)) & np.uint64(63)
                hit = np.flatnonzero((found >> bit) & np.uint64(1))
                own, found = own[hit], found[hit]
            out.append(own)
        return np.concatenate(out)

    def edited(self, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
        """(rows, words) that the filter lets through, of words of one length."""
        length = matrix.shape[1]
        step = max(1, _AT_ONCE // length)
        for at in range(0, len(matrix), step):
            part = matrix[at : at + step]
            power = powers(length + 1)
            each = BYTE_KEYS[part] * power[:length]
            total = each.sum(axis=1, dtype=np.uint64)
            if min(length, _TOP) in self.shards:
                yield from self._replaced(part, each, total, at)
            if length > LEAST_LETTERS and min(length - 1, _TOP) in self.shards:
                yield from self._deleted(part, each, total, at)

    def _replaced(self, part, each, total, at):
        length = part.shape[1]
        rest, power = (total[:, None] - each).ravel(), np.tile(powers(length), len(part))
        flat = part.ravel()
        for letter in self.alphabet:
            earlier = np.flatnonzero(flat < letter)
            place = earlier[self._held(rest[earlier] + BYTE_KEYS[letter] * power[earlier], length)]
            if len(place):
                row, column = place // length, place % length
                made = part[row]
                made[np.arange(len(row)), column] = letter
                yield at + row, _texts(made)

    def _deleted(self, part, each, total, at):
        length = part.shape[1]
        upto = np.cumsum(each, axis=1, dtype=np.uint64)
        inverse = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))
        raw = (upto - each) + (total[:, None] - upto) * inverse
        # Of equal letters in a row the first stands for all.
        first = np.ones(part.shape, bool)
        first[:, 1:] = part[:, 1:] != part[:, :-1]
        wanted = np.flatnonzero(first.ravel())
        place = wanted[self._held(raw.ravel()[wanted], length - 1)]
        if len(place):
            row, column = place // length, place % length
            left = np.ones((len(row), length), bool)
            left[np.arange(len(row)), column] = False
            yield at + row, _texts(part[row][left].reshape(len(row), length - 1))


def _texts(matrix: np.ndarray) -> list[str]:
    size = matrix.shape[1]
    joined = matrix.tobytes().decode("latin-1")
    return [joined[i : i + size] for i in range(0, len(joined), size)]


def _alphabet(words: DataFrame) -> np.ndarray:
    """The letters of all words, at most 90."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = sorted(set("".join(batch.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.string())], ["letter"])

    rows = words.select("word").mapInArrow(task, "letter string").distinct().collect()
    return np.array(sorted(ord(r.letter) for r in rows), np.uint8)


def candidates(words: DataFrame, round_slots: int = ROUND_SLOTS) -> DataFrame:
    """(made, word, n): what the filters let through, from (word, n, class)."""
    spark = words.sparkSession
    sizes = words.groupBy("class").agg(F.sum(F.char_length("word")).alias("letters")).collect()
    alphabet = _alphabet(words)
    found = spark.createDataFrame([], "made string, word string, n bigint")
    for shards in rounds_of({r["class"]: r.letters for r in sizes}, round_slots):
        sent = spark.sparkContext.broadcast(_filter(words, shards))

        def task(batches: Iterator[pa.RecordBatch], shards=shards, sent=sent) -> Iterator[pa.RecordBatch]:
            prober = _Prober(sent.value, shards, alphabet)
            for batch in batches:
                for matrix, rows in _lengths(batch.column(0)):
                    for row, made in prober.edited(matrix):
                        own = batch.take(pa.array(rows[row]))
                        columns = [pa.array(made, pa.string()), *own.columns]
                        yield pa.RecordBatch.from_arrays(columns, ["made", "word", "n"])

        lengths = {s.length for s in shards}
        own = words.filter(F.col("class").isin(sorted(lengths | {min(x + 1, _TOP) for x in lengths})))
        passed = own.select("word", "n").mapInArrow(task, "made string, word string, n bigint")
        found = found.union(stored(passed, "edits"))
        sent.unpersist()
    return found


def near_words(words: DataFrame, round_slots: int = ROUND_SLOTS) -> DataFrame:
    """(word, n, near, near_n): each pair of near words, in both directions."""
    known = words.select(F.col("word").alias("made"), F.col("n").alias("made_n"))
    pairs = candidates(words, round_slots).join(known, "made")
    both = [
        F.struct(F.col(a).alias("word"), F.col(x).alias("n"), F.col(b).alias("near"), F.col(y).alias("near_n"))
        for a, x, b, y in (("word", "n", "made", "made_n"), ("made", "made_n", "word", "n"))
    ]
    return pairs.select(F.explode(F.array(*both)).alias("_pair")).select("_pair.*")


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", round_slots: int = ROUND_SLOTS
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    length = F.least(F.char_length("word"), F.lit(_TOP)).alias("class")
    words = stored(vocabulary(docs, id_col, text_col).select("word", "n", length), "words")
    most = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("_most")
    best = near_words(words, round_slots).groupBy("word").agg(F.count("*").alias("n_near"), most)
    formed = F.col("_most.near_n") >= RATIO * F.col("n")
    table = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("_most.near")).alias("form"),
        F.when(formed, F.col("_most.near_n")).alias("form_n"),
    )
    table = stored(table, "forms")
    links = stored(table.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "links")
    largest = table.agg(F.max("n")).first()[0] or 0
    # Counts grow tenfold per link, from two on; each pass doubles what is followed.
    longest = int(math.log10(max(largest, LEAST_COUNT) / LEAST_COUNT)) + 1
    for _ in range((longest - 1).bit_length()):
        further = links.toDF("root", "_further")
        links = stored(
            links.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "links"
        )
    return table.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
