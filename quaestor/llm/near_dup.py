"""Near duplicates by HyperMinHash: compressed minima, bands, corrected estimates.

A document's set is its distinct five-word shingles (the whole text if it has
fewer words). The hash of a shingle names one of 256 buckets, and a bucket keeps
the smallest rest it saw, compressed to 16 bits: the count of its leading zeros
and ten bits of mantissa after them. Empty buckets borrow from a full one chosen
by a fixed random table, so small sets fill all registers too.

1. Rows of equal sets are one node, with a number of its own; only nodes go on.
   A component is named after the smallest id among its rows at the very end.
2. Registers are banded, by seven unless the rule says otherwise. Nodes that
   share a band are compared with one node of it, not with each other: the one
   that meets others most often, as copies lie nearer to a middle than to a rim.
3. The estimate of the similarity, corrected for the chance that two different
   minima compress to the same register, discards candidates that lie more than
   five standard errors below the threshold; what is left is confirmed on the
   full sets, cut from the whole texts.
4. Confirmed links make components. A band whose nodes still lie in different
   components is open: step 2 compared its nodes with one of them only. The nodes
   of open bands are joined once more, on their rarest shingles: of a set of n,
   at 85 % a link needs one common shingle among the n - 0.85 n + 1 that fewest
   of these nodes have, early enough to leave room for the rest of the overlap.
   Pairs inside a component are left out, as they could not change the result. What is
   left goes through step 3.

Two texts at the threshold of 0.85 share no band of seven with a chance below
1e-6; at 0.8 that takes bands of six, with a chance of about 3e-6. Step 4 is
exact for the nodes it takes, and never lists the pairs of a band: a thousand
copies with edits of their own, too far apart to link, differ in their rarest
shingles.

Null and empty texts have the empty set and link with nothing. Repeated rows of
an id get the same component; if an id has several texts, each row gets the
component of its own text, and is kept if that bears its id. A null id takes no part: its rows are kept, with a
null component. An empty table gives no rows. Only the id and
text columns are read. The broadcast tables are left to adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quaestor.llm.bloom import anti_join, semi_join
from quaestor.llm.stored import stored
from quaestor.llm.textops import Block, blocks, map_blocks, mix, windows, words

SHINGLE_WORDS = 5

_BUCKET_BITS = 8
_BUCKETS = 1 << _BUCKET_BITS
_MANTISSA_BITS = 10

#: Which bucket an empty one borrows from, at each of so many attempts.
_BORROW = mix(np.arange(1, 512 * _BUCKETS + 1, dtype=np.uint64)).reshape(512, _BUCKETS) % np.uint64(
    _BUCKETS
)
_BAND_KEYS = mix(np.arange(7, 7 + _BUCKETS, dtype=np.uint64)) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Linked if 100 * intersection >= percent * union."""

    percent: int = 85
    errors: float = 5.0
    band_rows: int = 7


def shingle_sets(block: Block) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each document of a block."""
    hashes, document = words(block)
    counts = np.bincount(document, minlength=len(block))
    shingles, at = windows(hashes, document, SHINGLE_WORDS)
    cuts = np.searchsorted(document[at], np.arange(1, len(block)))
    sets = [np.unique(x) for x in np.split(shingles, cuts)]
    begin = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):
        whole = hashes[begin[i] : begin[i] + counts[i]]
        keys = np.arange(1, len(whole) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sets[i] = mix(np.array([mix(whole ^ keys).sum() ^ np.uint64(counts[i])], np.uint64))
    return sets


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash of a non-empty set, as `uint16`."""
    bucket = (shingles >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
    # Ascending hashes: the first of a bucket is its smallest.
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    full = bucket[first]
    rest = shingles[first] << np.uint64(_BUCKET_BITS)
    width = np.frexp(rest.astype(np.float64))[1]
    zeros = np.clip(64 - width, 0, 63)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - _MANTISSA_BITS)
    value = (zeros.astype(np.uint64) << np.uint64(_MANTISSA_BITS)) | mantissa
    # A register tells which bucket it comes from only by its place.
    out = np.zeros(_BUCKETS, np.uint16)
    seen = np.zeros(_BUCKETS, bool)
    out[full], seen[full] = value.astype(np.uint16), True
    source = seen.copy()
    for attempt in _BORROW:
        empty = np.flatnonzero(~seen)
        if not len(empty):
            return out
        lender = attempt[empty].astype(np.int64)
        took = source[lender]
        out[empty[took]], seen[empty[took]] = out[lender[took]], True
    out[~seen] = out[full[0]]
    return out


#: What tells two sets apart: their size and two sums of mixed hashes.
KEYS = ["n_shingles", "set_a", "set_b"]


def _set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    mixed = [mix(s) for s in sets]
    sums = [[m.sum() for m in mixed], [mix(m).sum() for m in mixed]]
    return [
        pa.array([len(s) for s in sets], pa.int64()),
        *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in sums],
    ]


def with_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the keys of each row's set in three last columns, `_n_shingles` and so on."""
    names = [f"_{k}" for k in KEYS]
    at = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        rows = batch.slice(block.first, len(block))
        return pa.RecordBatch.from_arrays([*rows.columns, *_set_keys(shingle_sets(block))], [*rows.schema.names, *names])

    schema = docs.schema
    for name in names:
        schema = StructType([*schema.fields, StructField(name, LongType())])
    return docs.mapInArrow(lambda batches: map_blocks(batches, at, make), schema)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, registers): equal sets have equal keys."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        sets = shingle_sets(block)
        columns = [
            batch.column(0)[block.rows],
            *_set_keys(sets),
            pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        ]
        names = ["doc_id", *KEYS, "registers"]
        return pa.RecordBatch.from_arrays(columns, names)

    return own.mapInArrow(
        lambda batches: map_blocks(batches, 1, make),
        f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, registers binary",
    )


def _bands(nodes: DataFrame, band_rows: int) -> DataFrame:
    """(band, node, n_shingles): a row for each band of each node."""
    kind = nodes.schema["node"].dataType.simpleString()
    n_bands = _BUCKETS // band_rows
    used = n_bands * band_rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                regs = _matrix(part.column(2))[:, :used].astype(np.uint64) + 1
                keyed = (regs * _BAND_KEYS[:used]).reshape(-1, n_bands, band_rows)
                band = mix(keyed.sum(axis=2) + np.arange(n_bands, dtype=np.uint64) * _BAND_KEYS[-1])
                take = pa.array(np.repeat(np.arange(len(part)), n_bands))
                columns = [
                    pa.array(band.ravel().view(np.int64)),
                    part.column(0).take(take),
                    part.column(1).take(take),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["band", "node", "n_shingles"])

    return nodes.mapInArrow(task, f"band bigint, node {kind}, n_shingles bigint")


def _leaders(shared: DataFrame) -> DataFrame:
    """(band, leader): of each band the node that meets others most often over all its bands.

    A copy with few edits of its own keeps the bands of the text that the others
    were made from, so it is near most of them; ties go to the smallest node.
    """
    met = shared.groupBy("node").agg(F.sum("_held").alias("_met"))
    central = F.struct("_met", -F.col("node"))
    return shared.join(met, "node").groupBy("band").agg(F.max_by("node", central).alias("leader"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The registers of a batch, one row each."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, np.uint16).reshape(len(column), _BUCKETS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from equal registers, less those equal by chance.

    Two minima of sets of n and m elements compress alike with a chance of about
    0.17 * 2^-bits * 4(n/m)/(1 + n/m)^2.
    """
    ratio = n / m
    chance = 0.169919487159739093975 * 2.0**-_MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    same = (a == b).mean(axis=1)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _promising(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose estimate leaves room for a link."""
    side = nodes.select("node", "n_shingles", "registers")
    left = side.toDF("a", "n", "x")
    right = side.toDF("b", "m", "y")
    fit = F.least("n", "m") * 100 >= F.greatest("n", "m") * rule.percent
    met = pairs.join(left, "a").join(right, "b").filter(fit).select("a", "b", "n", "m", "x", "y")
    kind = pairs.schema["a"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = rule.percent / 100
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                n, m = (part.column(i).to_numpy().astype(float) for i in (2, 3))
                guess = estimate(_matrix(part.column(4)), _matrix(part.column(5)), n, m)
                filled = _BUCKETS * (1 - np.exp(-np.minimum(n, m) / _BUCKETS))
                error = np.sqrt(target * (1 - target) / np.maximum(filled, 1))
                keep = pa.array(guess >= target - rule.errors * error)
                yield part.select(["a", "b"]).filter(keep)

    return met.mapInArrow(task, f"a {kind}, b {kind}").distinct()


def _texts(texts: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes in the first column of `wanted`, from (doc_id, text).

    An id may have texts of several sets, so the texts that its id fetches are
    told apart by the keys of their sets.
    """
    named = sets.join(wanted.toDF("node").distinct(), "node").select("node", "doc_id", *KEYS)
    named = stored(named, "wanted")
    rows = semi_join(texts, named.select("doc_id").distinct(), "doc_id").distinct()
    own = with_keys(rows).toDF("doc_id", "text", *KEYS)
    return stored(own.join(named, ["doc_id", *KEYS]).select("node", "text"), "texts")


def _confirmed(pairs: DataFrame, own: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that meet the rule on their full sets, from the texts (node, text) of their nodes."""
    met = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                sets = [
                    [s for block in blocks(part.column(i)) for s in shingle_sets(block)] for i in (2, 3)
                ]
                keep = [_linked(x, y, rule.percent) for x, y in zip(*sets)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "x", "y").mapInArrow(task, f"a {kind}, b {kind}").distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """(node, n, shingle): a row per distinct shingle of each text."""
    kind = texts.schema["node"].dataType.simpleString()

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        sets = shingle_sets(block)
        sizes = np.array([len(s) for s in sets], np.int64)
        columns = [
            batch.column(0)[block.rows].take(pa.array(np.repeat(np.arange(len(sets)), sizes))),
            pa.array(np.repeat(sizes, sizes)),
            pa.array(np.concatenate(sets).view(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["node", "n", "shingle"])

    return texts.select("node", "text").mapInArrow(
        lambda batches: map_blocks(batches, 1, make), f"node {kind}, n bigint, shingle bigint"
    )


def _sharing_rare(rows: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of different components that may link, by their rarest shingles.

    Before its first common shingle, at place p of its order, a set of n has
    nothing in common with the other: at most n - p is left for the overlap.
    """
    rows = stored(rows, "shingles")
    held = rows.groupBy("shingle").agg(F.count("*").alias("held")).filter(F.col("held") > 1)
    # Shingles of one node only come first in its order, whatever their order there.
    common = rows.join(held, "shingle")
    first = Window.partitionBy("node", "n").orderBy("held", "shingle")
    placed = common.withColumn("_rank", F.row_number().over(first)).withColumn(
        "_common", F.count("*").over(Window.partitionBy("node", "n"))
    )
    place = F.col("n") - F.col("_common") + F.col("_rank") - 1
    reach = F.col("n") - F.floor((F.col("n") * rule.percent + 99) / 100) + 1
    early = placed.withColumn("place", place).filter(F.col("place") < reach)
    early = early.join(nodes, "node").select("shingle", "node", "component", "n", "place")
    left = early.toDF("shingle", "a", "x", "n", "p")
    right = early.toDF("shingle", "b", "y", "m", "q")
    room = F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q"))
    enough = 100 * room >= rule.percent * (F.col("n") + F.col("m") - room)
    apart = (F.col("a") < F.col("b")) & (F.col("x") != F.col("y"))
    return left.join(right, "shingle").filter(apart & enough).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over (a, b), for nodes with links.

    Every round takes the smallest label of the neighbours and then the label of
    that label, so the length of a chain about doubles each time. A hub's links
    are an equi join that adaptive execution splits, and minima are taken on the
    map side first.
    """
    both = stored(
        links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("near"))
        ),
        "links",
    )
    labels = stored(
        both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")), "labels"
    )
    while True:
        of_near = labels.toDF("near", "component")
        best = both.join(of_near, "near").groupBy("node").agg(F.min("component").alias("_best"))
        step = labels.join(best, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_best").alias("_new")
        )
        jump = labels.toDF("_new", "_jump")
        moved = stored(
            step.join(jump, "_new").select("node", "_old", F.least("_new", "_jump").alias("component")),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.filter(F.col("_old") != F.col("component")).isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`."""
    return groups(docs, rule, id_col, text_col).drop("set_a", "set_b")


def groups(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`near_duplicates` with the keys of each row's set (n_shingles, set_a, set_b)."""
    signed = stored(signatures(docs, id_col, text_col), "signatures")
    takes_part = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    one = takes_part.groupBy(*KEYS).agg(F.min("doc_id").alias("doc_id"))
    sets = stored(one.withColumn("node", F.monotonically_increasing_id()), "sets")
    # Equal sets have equal registers.
    nodes = takes_part.join(sets, ["doc_id", *KEYS]).select("node", "n_shingles", "registers").distinct()
    nodes = stored(nodes, "nodes")

    bands = _bands(nodes, rule.band_rows)
    held = bands.groupBy("band").agg(F.count("*").alias("_held")).filter(F.col("_held") > 1)
    shared = stored(bands.join(held, "band"), "bands")
    leaders = _leaders(shared)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pairs = (
        shared.join(leaders, "band")
        .filter(F.col("node") != F.col("leader"))
        .select(F.col("leader").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    promising = stored(_promising(pairs, nodes, rule), "pairs")
    star_texts = _texts(texts, sets, promising.select(F.explode(F.array("a", "b"))))
    links = stored(_confirmed(promising, star_texts, rule), "star")
    labels = components(links)

    named = shared.join(labels, "node", "left").select(
        "band", "node", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    named = stored(named, "named")
    open_bands = (
        named.groupBy("band")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .filter(F.col("_low") != F.col("_high"))
        .select("band")
    )
    unsure = named.join(open_bands, "band", "left_semi").select("node", "component").distinct()
    unsure = stored(unsure, "unsure")
    own_texts = _texts(texts, sets, unsure.select("node"))
    across = _sharing_rare(_shingle_rows(own_texts), unsure, rule).join(pairs, ["a", "b"], "left_anti")
    promising = stored(_promising(across, nodes, rule), "across")
    if not promising.isEmpty():
        more = stored(_confirmed(promising, own_texts, rule), "more")
        if not more.isEmpty():
            labels = components(links.union(more))

    members = sets.join(labels, "node", "left").select(
        *KEYS, "doc_id", F.coalesce("component", "node").alias("component")
    )
    members = stored(members, "members")
    names = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    members = members.join(names, "component").select(*KEYS, "component_id")
    own = ["doc_id", "n_shingles", "component_id", "set_a", "set_b"]
    linked = takes_part.join(members, KEYS).select(*own)
    apart = signed.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    apart = apart.withColumn("component_id", F.col("doc_id")).select(*own)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return linked.union(apart).select(*own[:3], kept.alias("kept"), *own[3:])


def one_of_each(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept: of each group the row of the smallest id.

    Of a kept id and set that occur in several rows the first by text stays;
    copies of a row meet on the map side. Rows of a null id all stay.
    """
    found = stored(groups(docs, rule, id_col, text_col).filter(F.col("doc_id").isNotNull()), "groups")
    again = stored(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    dropped = found.filter(~F.col("kept")).select("doc_id").union(again).distinct()
    left = anti_join(docs, stored(dropped, "dropped"), id_col)
    if again.isEmpty():
        return left
    # Rows of an id that occurs again are told apart by their sets.
    several = with_keys(semi_join(docs, again, id_col), text_col)
    kept = found.filter("kept").join(again, "doc_id", "left_semi").select("doc_id", *KEYS).distinct()
    kept = kept.toDF(id_col, *[f"_{k}" for k in KEYS])
    of = [id_col, *[f"_{k}" for k in KEYS]]
    first = F.min_by(F.struct(*docs.columns), F.struct(text_col)).alias("_row")
    one = several.join(kept, of, "left_semi").groupBy(*of).agg(first).select("_row.*")
    return left.union(one)
