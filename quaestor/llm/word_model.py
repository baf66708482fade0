"""Surprise of texts under a modified Kneser-Ney model of words after word endings.

Words are `[^\\x20\\x09-\\x0D]+` as they are written, told apart by 60 bits of a
hash (among a billion distinct words about one in a billion meets another). The
context of a word is the ending of the word before it, in 15 classes by its last
two bytes, or the start of the text; below it stand the words alone, by how many
contexts they follow. The counts grow with the training texts.

A word's hash and its context's class are one 64-bit key, so the keys of a word
lie together. A task counts the keys of a million words at a time and ships
them as sorted, delta-coded arrays, one row for each shard of the key space. A
shard merges its arrays and has all that its estimates need but the totals of the
16 contexts and a few counts of counts, which alone reach the driver.

Texts are scored in two steps that together give every key its exact estimate.
The keys of largest count (at most HEAD, 42 MB, whatever the corpus) ride to the
tasks. Keys that aren't among them go to their shards in sorted arrays as above,
and come back as values that are added to their texts.

A text of the training set has seen itself. Its second surprise leaves that out:
a key that occurs nowhere else counts as unseen, and so do its word and its
context if they occur in that key alone.

Texts are told apart by `xxhash64`. Copies of a text have one row. Texts without
a word have none. Without training texts every surprise is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.kneser_ney import _discounts
from quaestor.llm.stored import stored
from quaestor.llm.textops import ASCII_SPACE, BYTE_KEYS, Block, blocks, hash_runs, mix

_CLASS_BITS = 4
CLASSES = 1 << _CLASS_BITS
_CLASS = np.uint64(CLASSES - 1)

#: Words that a task counts at a time, and keys whose estimates ride to the tasks.
SPILL = 1 << 20
HEAD = 1 << 21


def key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Key and document of each word of a block."""
    starts, ends, document = block.runs(~ASCII_SPACE[block.data])
    hashes = hash_runs(block.data, starts, ends)
    last, before = (block.data[np.maximum(ends - k, starts)].astype(np.int64) for k in (1, 2))
    context = np.roll(1 + (31 * last + 7 * before) % (CLASSES - 1), 1)
    context[np.flatnonzero(np.diff(document, prepend=-1))] = 0
    return (hashes & ~_CLASS) | context.astype(np.uint64), document


def _packed(values: np.ndarray) -> bytes:
    """An array's bytes by place, compressed: small numbers leave most places empty."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _packed_keys(ascending: np.ndarray) -> bytes:
    return _packed(np.diff(ascending, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _cuts(ascending: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """The shards that have some of the keys, and where those lie."""
    shard = (ascending >> np.uint64(44)) * np.uint64(shards) >> np.uint64(20)
    ends = np.searchsorted(shard, np.arange(1, shards + 1).astype(np.uint64))
    for s in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        yield s, slice(int(ends[s - 1]) if s else 0, int(ends[s]))


def _shards(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _merge(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(found, kind="stable")
    found = found[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, int)
    return found[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def key_counts(texts: DataFrame) -> DataFrame:
    """(shard, keys, counts): a row per shard and spill of a task, of (text)."""
    shards, most = _shards(texts), SPILL

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                waiting.append(keys(block)[0])
                size += len(waiting[-1])
                if size >= most:
                    yield from spilled(waiting)
                    waiting, size = [], 0
        if size:
            yield from spilled(waiting)

    def spilled(waiting: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(waiting), return_counts=True)
        for s, own in _cuts(found, shards):
            yield _batch([[s], [_packed_keys(found[own])], [_packed(n[own])]], "shard", "keys", "counts")

    return texts.mapInArrow(task, "shard int, keys binary, counts binary")


_TYPES = {"shard": pa.int32(), "kind": pa.int32(), "spill": pa.int64(), "stats": pa.list_(pa.int64())}


def _batch(columns: list[list], *names: str) -> pa.RecordBatch:
    arrays = [pa.array(c, _TYPES.get(n, pa.binary())) for c, n in zip(columns, names)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for i in range(len(batch)):
            yield [c[i].as_py() for c in batch.columns]


#: What a shard reports: counts of counts of keys and of words, words, keys, then for each
#: context its total and its keys seen once, twice and more, then keys by bits of their count.
_BITS = 48
_N_STATS = 10 + 4 * CLASSES + _BITS


def _stats(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    contexts = (found & _CLASS).astype(np.int64)
    first = np.flatnonzero(np.diff(found >> np.uint64(_CLASS_BITS), prepend=np.uint64(1 << 63)))
    follows = np.diff(np.append(first, len(found)))
    by_context = [np.bincount(contexts, n, CLASSES)]
    by_context += [np.bincount(contexts[own], minlength=CLASSES) for own in (n == 1, n == 2, n > 2)]
    bits = np.bincount(np.minimum(np.log2(n).astype(np.int64), _BITS - 1), minlength=_BITS)
    heads = [np.bincount(np.minimum(x, 5), minlength=6)[1:5] for x in (n, follows)]
    return np.concatenate([*heads, [len(first), len(found)], *by_context, bits]).astype(np.int64)


def merged(counts: DataFrame) -> DataFrame:
    """(shard, keys, counts, stats): one row per shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for own, *arrays in _rows(batches):
            if own != shard and parts:
                yield whole(shard, parts)
                parts = []
            shard = own
            parts.append((_unpacked_keys(arrays[0]), _unpacked(arrays[1], np.int64)))
        if parts:
            yield whole(shard, parts)

    def whole(shard: int, parts: list[tuple]) -> pa.RecordBatch:
        found, n = _merge(*[np.concatenate(c) for c in zip(*parts)])
        columns = [[shard], [_packed_keys(found)], [_packed(n)], [_stats(found, n)]]
        return _batch(columns, "shard", "keys", "counts", "stats")

    # Arrays of a shard follow each other in its task, which holds one shard at a time.
    dealt = counts.repartition(_shards(counts), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(task, "shard int, keys binary, counts binary, stats array<bigint>")


@dataclass(frozen=True)
class Constants:
    """What the estimates of all shards share."""

    of_keys: tuple[float, float, float]  # discounts
    of_words: tuple[float, float, float]
    total: np.ndarray  # by context
    weight: np.ndarray
    every: float  # keys
    unseen: float  # probability of an unknown word
    head: int  # keys of so many occurrences ride to the tasks

    @classmethod
    def of(cls, table: DataFrame, head: int) -> Constants:
        # One row for each place of the statistics.
        summed = table.select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        stats = np.zeros(_N_STATS)
        for r in summed:
            stats[r.pos] = r.n
        d1, d0 = _discounts(stats[:4].tolist()), _discounts(stats[4:8].tolist())
        words, every = stats[8:10]
        total, *seen = stats[10 : 10 + 4 * CLASSES].reshape(4, CLASSES)
        taken = sum(d * n for d, n in zip(d1, seen))
        weight = np.divide(taken, total, out=np.ones(CLASSES), where=total > 0)
        kept_back = words and cls._taken_from_words(table, d0)
        unseen = (kept_back / every if every else 1.0) / (words + 1)
        bits = stats[10 + 4 * CLASSES :]
        below = np.flatnonzero(np.cumsum(bits[::-1])[::-1] <= head)
        least = 1 << int(below[0]) if len(below) else 1 << _BITS
        return cls(d1, d0, total, weight, max(every, 1.0), unseen, least)

    @staticmethod
    def _taken_from_words(table: DataFrame, d0: tuple[float, float, float]) -> float:
        """The discounts of all words: those that follow one context, two and more."""
        at = F.col("stats")
        once, twice, words = at[4], at[5], at[8]
        r = table.select(F.sum(once).alias("one"), F.sum(twice).alias("two"), F.sum(words).alias("all")).first()
        return d0[0] * r.one + d0[1] * r.two + d0[2] * (r.all - r.one - r.two)


def _taken(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


class Estimates:
    """The sorted keys of a shard with their counts, surprises and those left alone."""

    def __init__(self, found: np.ndarray, n: np.ndarray, known: Constants):
        self.found, self.n, self.known = found, n, known
        first = np.flatnonzero(np.diff(found >> np.uint64(_CLASS_BITS), prepend=np.uint64(1 << 63)))
        follows = np.diff(np.append(first, len(found)))
        uses = np.repeat(np.add.reduceat(n, first), follows) if len(first) else n
        p = (follows - _taken(follows, known.of_words)) / known.every + known.unseen
        self.p_word = np.repeat(p, follows)
        context = (found & _CLASS).astype(np.int64)
        total, weight = known.total[context], known.weight[context]
        own = (n - _taken(n, known.of_keys)) / np.maximum(total, 1)
        self.surprise = -np.log(own + weight * self.p_word)
        alone = np.where(total > n, weight, 1.0) * np.where(uses > n, self.p_word, known.unseen)
        self.alone = -np.log(alone)

    def look_up(self, wanted: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surprise of each key, and that of a text that has it so many times itself."""
        weight = self.known.weight[(wanted & _CLASS).astype(np.int64)]
        p_word = np.full(len(wanted), self.known.unseen)
        if not len(self.found):
            value = -np.log(weight * p_word)
            return value, value
        last = len(self.found) - 1
        # The first key of the word tells whether another context has it.
        place = np.minimum(np.searchsorted(self.found, wanted & ~_CLASS), last)
        same = (self.found[place] ^ wanted) <= _CLASS
        p_word[same] = self.p_word[place[same]]
        value = -np.log(weight * p_word)
        place = np.minimum(np.searchsorted(self.found, wanted), last)
        hit = self.found[place] == wanted
        alone = value.copy()
        value[hit] = self.surprise[place[hit]]
        alone[hit] = np.where(self.n[place[hit]] <= times[hit], self.alone[place[hit]], value[hit])
        return value, alone


def _head(table: DataFrame, known: Constants) -> tuple[np.ndarray, ...]:
    """Keys of large counts, ascending, with (n, surprise, alone); at most HEAD rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in _rows(batches):
            own = Estimates(_unpacked_keys(found), _unpacked(n, np.int64), known)
            top = np.flatnonzero(own.n >= known.head)
            if len(top):
                n = np.minimum(own.n[top], (1 << 31) - 1).astype(np.int32)
                values = [own.surprise[top].astype(np.float32), own.alone[top].astype(np.float32)]
                columns = [[_packed_keys(own.found[top])], [_packed(n)], *[[_packed(v)] for v in values]]
                yield _batch(columns, "keys", "n", "surprise", "alone")

    rows = table.select("keys", "counts").mapInArrow(task, "keys binary, n binary, surprise binary, alone binary")
    kinds = (np.int32, np.float32, np.float32)
    parts = [(_unpacked_keys(r[0]), *[_unpacked(b, k) for b, k in zip(r[1:], kinds)]) for r in rows.collect()]
    parts.sort(key=lambda p: p[0][0])
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.uint64, *kinds))
    return tuple(np.concatenate(c) for c in zip(*parts))


#: Sums of a text: words, surprises, their squares, and the last two without itself.
_SUMS = 5


def _asked(texts: DataFrame, head: tuple[np.ndarray, ...]) -> DataFrame:
    """Per spill of a task a row (kind 0) with its texts' sums, and rows (kind 1) of keys to look up."""
    shards, most = _shards(texts), SPILL
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names, sums, asked, size, documents = [], [], [], 0, 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                own, missed, words = known_part(block)
                names.append(batch.column(1)[block.rows])
                sums.append(own)
                asked.append((missed[0], missed[1] + documents, missed[2]))
                documents += len(block)
                size += words
                if size >= most:
                    yield from spilled(number, names, sums, asked)
                    names, sums, asked, size, documents = [], [], [], 0, 0
                    number += 1
        if documents:
            yield from spilled(number, names, sums, asked)

    def known_part(block: Block) -> tuple[np.ndarray, tuple, int]:
        found, document = keys(block)
        apart = mix(found + BYTE_KEYS[3] * (document + 1).astype(np.uint64))
        _, at, times = np.unique(apart, return_index=True, return_counts=True)
        wanted, own = found[at], document[at]
        top, n, surprise, alone = sent.value
        sums = np.zeros((_SUMS, len(block)))
        sums[0] = np.bincount(own, times, len(block))
        hit = np.zeros(len(wanted), bool)
        if len(top):
            place = np.minimum(np.searchsorted(top, wanted), len(top) - 1)
            hit = top[place] == wanted
            place = place[hit]
            value = surprise[place].astype(np.float64)
            left = np.where(n[place] <= times[hit], alone[place], value)
            _add(sums, own[hit], times[hit], value, left)
        return sums, (wanted[~hit], own[~hit].astype(np.uint32), times[~hit].astype(np.uint32)), len(found)

    def spilled(number: int, names: list, sums: list, asked: list) -> Iterator[pa.RecordBatch]:
        text_keys = np.concatenate([x.to_numpy() for x in names])
        columns = [[0], [number], [None], [_packed(text_keys)], [_packed(np.concatenate(sums, axis=1).ravel())], [None]]
        yield _batch(columns, *columns_)
        wanted, document, times = (np.concatenate(c) for c in zip(*asked))
        order = np.argsort(wanted, kind="stable")
        wanted, document, times = wanted[order], document[order].astype(np.uint32), times[order]
        for s, own in _cuts(wanted, shards):
            packed = [_packed_keys(wanted[own]), _packed(document[own]), _packed(times[own])]
            yield _batch([[1], [number], [s], *[[p] for p in packed]], *columns_)

    columns_ = ("kind", "spill", "shard", "a", "b", "c")
    return texts.mapInArrow(task, "kind int, spill bigint, shard int, a binary, b binary, c binary")


def _add(sums: np.ndarray, document: np.ndarray, times: np.ndarray, value: np.ndarray, alone: np.ndarray) -> None:
    for j, x in enumerate((value, value * value, alone, alone * alone), 1):
        sums[j] += np.bincount(document, times * x, sums.shape[1])


def _answers(asked: DataFrame, table: DataFrame, known: Constants) -> DataFrame:
    """(kind, spill, a, b, c): documents, times and values of the keys that were asked for."""
    model = table.select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("spill"), "shard",
                         F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(None).cast("binary").alias("c"))
    both = asked.unionByName(model).select("shard", "kind", "spill", "a", "b", "c")
    dealt = both.repartition(_shards(table), "shard").sortWithinPartitions("shard", "kind")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Estimates(np.zeros(0, np.uint64), np.zeros(0, np.int64), known)
        shard, own = None, none
        for at, kind, spill, a, b, c in _rows(batches):
            if at != shard:
                shard, own = at, none
            if kind == 0:
                own = Estimates(_unpacked_keys(a), _unpacked(b, np.int64), known)
                continue
            times = _unpacked(c, np.uint32)
            values = np.stack(own.look_up(_unpacked_keys(a), times)).astype(np.float32)
            yield _batch([[1], [spill], [b], [c], [_packed(values.ravel())]], "kind", "spill", "a", "b", "c")

    return dealt.mapInArrow(task, "kind int, spill bigint, a binary, b binary, c binary")


def surprises(texts: DataFrame, training: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """(key, words, surprise, error, surprise_alone, error_alone) of distinct texts of (text).

    The model is trained on `training`, by default on the texts themselves. The
    surprises are means per word, the errors their standard errors; the last two
    are those of a text that is itself in training.
    """
    counts = key_counts((texts if training is None else training).select("text"))
    table = stored(merged(counts), "word_counts")
    known = Constants.of(table, head)
    asked = stored(_asked(texts.select("text", key().alias("key")), _head(table, known)), "word_sums")
    answers = _answers(asked.filter("kind = 1"), table, known)
    parts = asked.filter("kind = 0").select("kind", "spill", "a", "b", "c").unionByName(answers)
    dealt = parts.select("spill", "kind", "a", "b", "c").repartition("spill").sortWithinPartitions("spill", "kind")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums = None, None
        for _, kind, a, b, c in _rows(batches):
            if kind == 0:
                if names is not None:
                    yield rows(names, sums)
                names = _unpacked(a, np.int64)
                sums = _unpacked(b, np.float64).reshape(_SUMS, -1).copy()
            else:
                value, alone = _unpacked(c, np.float32).astype(np.float64).reshape(2, -1)
                _add(sums, _unpacked(a, np.uint32), _unpacked(b, np.uint32), value, alone)
        if names is not None:
            yield rows(names, sums)

    def rows(names: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(sums[0])
        m, s, ss, a, aa = sums[:, some]
        error = lambda x, xx: np.sqrt(np.maximum(xx / m - (x / m) ** 2, 0) / m)
        columns = [names[some], m.astype(np.int64), s / m, error(s, ss), a / m, error(a, aa)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], fields)

    fields = ["key", "words", "surprise", "error", "surprise_alone", "error_alone"]
    scored = dealt.mapInArrow(task, "key bigint, words bigint, " + ", ".join(f"{c} double" for c in fields[2:]))
    # Copies of a text have the same sums.
    return scored.groupBy("key").agg(*[F.max(c).alias(c) for c in fields[1:]])
