"""Benchmark decontamination with spaced seeds.

Tokens are the words of the lower-cased text without signs at their ends. A seed
looks at some places of a window and ignores the others, so a window with
substituted tokens still has equal seeds wherever the substitutions fall on
ignored places. Items and documents are hashed with every mask at every place;
equal hashes are hits, and a hit names a diagonal: the item laid over the text
at one offset. On every diagonal with a hit the whole item is compared, and the
longest stretch with at least `identity` equal tokens is the overlap,
reported if it has `least_tokens`. The masks hit every such stretch.

The seeds of the documents never move: a Bloom filter of fixed size, made from
the items' seeds, lets few others than true hits through. Each group of hits
that lie close together in a text is one row with the tokens around them, as many
as the longest item has, so
the exact join on the seed and the comparison need no second look at the texts.
A seed that very many texts share is a hot key of an inner equi join, which
adaptive execution splits.

Items of equal tokens are one item, the smallest id. Items with fewer than
`least_tokens` tokens, null and empty ones match nothing, as do null and empty
texts. Repeated rows of a document give one row per item. Null ids are carried.
Empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.bloom import bloom, may_hold
from quaestor.llm.stored import stored
from quaestor.llm.textops import ASCII_SPACE, LOWER, PLACE_KEYS, Block, blocks, hash_runs, map_blocks, mix

#: The places that each mask looks at are 1.
MASKS = ("11111", "110111", "1110011", "1100011001")


@dataclass(frozen=True)
class Rule:
    least_tokens: int = 12
    identity: float = 0.8


#: ASCII signs, cut off the ends of a word.
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = [not chr(c).isalnum() for c in range(33, 127)]


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each token."""
    starts, ends, document = block.runs(~ASCII_SPACE[block.data])
    # The first and last byte of each word that isn't a sign.
    solid = np.flatnonzero(~_SIGN[block.data] & ~ASCII_SPACE[block.data])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.searchsorted(solid, starts)
    high = np.searchsorted(solid, ends) - 1
    some = high >= low
    starts, ends = solid[low[some]], solid[high[some]] + 1
    return hash_runs(LOWER[block.data], starts, ends), document[some]


def seeds(hashes: np.ndarray, document: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: seed hashes and the places where their windows begin."""
    for number, mask in enumerate(MASKS):
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, PLACE_KEYS[40 + number], np.uint64)
        for j, looked_at in enumerate(mask):
            if looked_at == "1":
                total += hashes[j : j + n] * PLACE_KEYS[j]
        inside = document[:n] == document[len(mask) - 1 :]
        yield mix(total)[inside], np.flatnonzero(inside)


def item_tokens(items: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item_tokens): distinct items that are long enough."""
    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = own.schema["item_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        hashes, document = tokens(block)
        lists = np.split(hashes.view(np.int64), np.searchsorted(document, np.arange(1, len(block))))
        column = pa.array(lists, pa.list_(pa.int64()))
        names = ["item_id", "item_tokens"]
        return pa.RecordBatch.from_arrays([batch.column(0)[block.rows], column], names)

    read = own.mapInArrow(lambda b: map_blocks(b, 1, make), f"item_id {kind}, item_tokens array<bigint>")
    long_enough = read.filter(F.size("item_tokens") >= rule.least_tokens)
    return long_enough.groupBy("item_tokens").agg(F.min("item_id").alias("item_id")).select(
        "item_id", "item_tokens"
    )


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, item_place) of every mask at every place of (item, item_tokens)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            document = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            begin = np.append(0, ends)
            for found, at in seeds(flat, document):
                columns = [
                    pa.array(found.view(np.int64)),
                    batch.column(0).take(pa.array(document[at])),
                    pa.array((at - begin[document[at]]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "item", "item_place"])

    return items.mapInArrow(task, "seed bigint, item bigint, item_place int")


def hit_groups(docs: DataFrame, words: np.ndarray, around: int, id_col: str, text_col: str) -> DataFrame:
    """(group, doc_id, start, doc_tokens, seeds, places): hits and `around` tokens on either side."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in blocks(batch.column(1)):
                out = groups(batch, block, group)
                group += out.num_rows
                if out.num_rows:
                    yield out

    def groups(batch: pa.RecordBatch, block: Block, first: int) -> pa.RecordBatch:
        hashes, document = tokens(block)
        hits = [(s[k], at[k]) for s, at in seeds(hashes, document) for k in [may_hold(words, s)]]
        at = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in hits]])
        seed = np.concatenate([np.zeros(0, np.uint64), *[x[0] for x in hits]])
        order = np.argsort(at, kind="stable")
        at, seed = at[order], seed[order]
        apart = (np.diff(at, prepend=-1) > 2 * around) | (np.diff(document[at], prepend=-1) != 0)
        cuts = np.flatnonzero(apart)
        ends = np.append(cuts[1:], len(at))[: len(cuts)]
        begin = np.searchsorted(document, np.arange(len(block) + 1))
        rows: list[list] = [[], [], [], [], []]
        for a, b in zip(cuts.tolist(), ends.tolist()):
            own = document[at[a]]
            low = max(begin[own], at[a] - around)
            high = min(begin[own + 1], at[b - 1] + around)
            values = (own, low - begin[own], hashes[low:high].view(np.int64), seed[a:b].view(np.int64), at[a:b] - low)
            for column, value in zip(rows, values):
                column.append(value)
        ids = batch.column(0)[block.rows].take(pa.array(rows[0], pa.int64()))
        columns = [
            pa.array(first + np.arange(len(cuts))),
            ids,
            pa.array(rows[1], pa.int64()),
            pa.array(rows[2], pa.list_(pa.int64())),
            pa.array(rows[3], pa.list_(pa.int64())),
            pa.array(rows[4], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["group", "doc_id", "start", "doc_tokens", "seeds", "places"]
    schema = (
        f"group bigint, doc_id {kind}, start bigint, doc_tokens array<bigint>, "
        "seeds array<bigint>, places array<bigint>"
    )
    return own.mapInArrow(task, schema)


def overlap(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """Start and end of the longest stretch with that share of equal tokens."""
    # A match gains 1 - identity, a mismatch costs identity: a stretch has the
    # share if its sum isn't negative. Whole numbers keep the border exact.
    part = round(identity * 1000)
    total = np.append(0, np.cumsum(np.where(equal, 1000 - part, -part)))
    lowest = np.minimum.accumulate(total)
    first = np.searchsorted(-lowest, -total)
    length = np.arange(len(total)) - first
    end = int(np.argmax(length))
    return int(first[end]), end


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    rule: Rule = Rule(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_equal): the longest overlap of each pair.

    Starts count tokens from 0. Documents without an overlap have no row.
    """
    read = item_tokens(items, rule, item_id_col, item_text_col)
    # A number of its own lets an item without an id take part in joins.
    known = stored(read.withColumn("item", F.monotonically_increasing_id()), "items")
    planted = stored(item_seeds(known.select("item", "item_tokens")), "seeds")
    words = bloom(planted.select("seed"))
    longest = known.agg(F.max(F.size("item_tokens"))).first()[0] or 0
    groups = stored(hit_groups(docs, words, longest, id_col, text_col), "hits")

    hits = groups.select("group", F.explode(F.arrays_zip("seeds", "places")).alias("hit"))
    hits = hits.select("group", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    diagonal = (F.col("place") - F.col("item_place")).alias("diagonal")
    laid = stored(hits.join(planted, "seed").select("group", "item", diagonal).distinct(), "diagonals")
    # Only what the item covers of the text, however long, goes to the comparison.
    low = F.greatest("diagonal", F.lit(0))
    n = F.least(F.size("doc_tokens"), F.col("diagonal") + F.size("item_tokens")) - low
    compared = (
        laid.join(known, "item")
        .join(groups.select("group", "doc_id", "start", "doc_tokens"), "group")
        .select(
            "doc_id",
            "item_id",
            (F.col("start") + low).alias("doc_start"),
            (low - F.col("diagonal")).alias("item_start"),
            F.slice("doc_tokens", (low + 1).cast("int"), n.cast("int")).alias("doc_tokens"),
            F.slice("item_tokens", (low - F.col("diagonal") + 1).cast("int"), n.cast("int")).alias("item_tokens"),
        )
    )
    kinds = [known.schema["item_id"].dataType.simpleString(), groups.schema["doc_id"].dataType.simpleString()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            starts, item_starts = (batch.column(c).to_numpy() for c in (2, 3))
            for i in range(len(batch)):
                text, item = (batch.column(c)[i].values.to_numpy() for c in (4, 5))
                equal = text == item
                s, e = overlap(equal, rule.identity)
                if e - s >= rule.least_tokens:
                    found.append((i, starts[i] + s, item_starts[i] + s, e - s, int(equal[s:e].sum())))
            rows = pa.array([f[0] for f in found], pa.int64())
            columns = [batch.column(c).take(rows) for c in (0, 1)]
            columns += [pa.array([f[j] for f in found], pa.int64()) for j in range(1, 5)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"]
    schema = (
        f"doc_id {kinds[1]}, item_id {kinds[0]}, doc_start bigint, item_start bigint, "
        "n_tokens bigint, n_equal bigint"
    )
    best = F.max(
        F.struct("n_equal", "n_tokens", (-F.col("doc_start")).alias("a"), (-F.col("item_start")).alias("b"))
    ).alias("best")
    return (
        compared.mapInArrow(task, schema)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            (-F.col("best.a")).alias("doc_start"),
            (-F.col("best.b")).alias("item_start"),
            F.col("best.n_tokens").alias("n_tokens"),
            F.col("best.n_equal").alias("n_equal"),
        )
    )
