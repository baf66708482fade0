"""Quality by a language model of trusted text, scored with sharded count joins.

A modified Kneser-Ney model of symbol n-grams is trained on the trusted texts
alone. The distinct n-grams of all texts get their probabilities from a chain of
joins with the count tables, one per order, so unseen ones back off there; the
result is cut into shards by a hash of the gram.

The texts come as blocks of up to 255 documents. A block lists for each shard
its grams, and for each gram the documents that have it and how often. Lists
meet the shard's probabilities in an equi join on (shard, salt): the salt deals
a shard's lists over the cluster, and a shard's probabilities, whose number is
bounded by the alphabet, are repeated once per salt. A joined list gives one
partial sum per document of its block, and the sums of a document are added up.

The symbol model is soon full, however large the corpus. What grows with it is a
second model of the trusted texts' words after word endings (see `word_model`). A
text is kept if neither model finds it too surprising.

Thresholds are quantiles of the mean surprise (log perplexity) of the trusted
texts, per language, with some room above; they are drawn towards that of all
trusted texts, as if 50 more had it. A short text's mean is uncertain, so it is held against
the threshold less four of its standard errors.

Null and empty texts have no perplexity and are not kept. Without any trusted
text nothing can be told apart and every text with a perplexity is kept. A null
language is one of its own. Repeated rows are scored each; a null id is carried
and is never trusted. An empty table gives no rows. Only the named columns are
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm import kneser_ney, word_model
from quaestor.llm.bloom import semi_join
from quaestor.llm.stored import stored
from quaestor.llm.symbols import BASE, grams
from quaestor.llm.textops import Block, blocks

ORDER = 3
SHARDS = 16

#: Documents of a block have numbers of one byte.
_BLOCK_DOCUMENTS = 255
#: Larger blocks name a gram less often.
_BLOCK_BYTES = 1 << 20
_MOST = 255  # of a count's byte; a larger count takes several entries


@dataclass(frozen=True)
class Rule:
    quantile: float = 0.99
    room: float = 0.05  # added to the threshold on log perplexity
    errors: float = 4.0
    drawn: float = 50.0  # texts' worth of the threshold of all in a language's own
    bins: int = 1000


def _shard_of(codes: np.ndarray) -> np.ndarray:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64) % SHARDS


def shards(probabilities: DataFrame, salts: int) -> DataFrame:
    """(shard, salt, grams, surprises): a shard's grams ascend."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy()
            shard = pa.array(_shard_of(codes).astype(np.int32))
            names = ["shard", "gram", "surprise"]
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], names)

    rows = probabilities.select(F.col("gram").cast("int"), (-F.log("p")).cast("float").alias("surprise"))
    placed = rows.mapInArrow(task, "shard int, gram int, surprise float")
    # At most 48^order / SHARDS rows come together here, of any corpus.
    listed = placed.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("gram", "surprise"))).alias("_all"))
    return listed.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.col("_all.gram").alias("grams"),
        F.col("_all.surprise").alias("surprises"),
    )


def lists(docs: DataFrame, order: int, salts: int) -> DataFrame:
    """(shard, salt, block, doc_ids, langs, keys, grams, ends, documents, counts) of (doc_id, lang, text, key).

    The list of shard 0 also names the documents of the block.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), _BLOCK_DOCUMENTS):
                part = batch.slice(at, _BLOCK_DOCUMENTS)
                for block in blocks(part.column(2), _BLOCK_BYTES):
                    yield make(part, block, number)
                    number += len(block)

    def make(part: pa.RecordBatch, block: Block, number: int) -> pa.RecordBatch:
        codes, offsets = grams(block, order)
        document = np.repeat(np.arange(len(block)), np.diff(offsets))
        entries, counts = np.unique(codes * 256 + document, return_counts=True)
        if counts.max(initial=0) > _MOST:
            times = -(-counts // _MOST)
            last = counts - (times - 1) * _MOST
            entries = np.repeat(entries, times)
            full = np.full(len(entries), _MOST, np.int64)
            full[np.cumsum(times) - 1] = last
            counts = full
        code, document = entries >> 8, (entries & 255).astype(np.uint8)
        shard = _shard_of(code)
        rows = []
        for s in range(SHARDS):
            own = np.flatnonzero(shard == s)
            begin = np.flatnonzero(np.diff(code[own], prepend=-1))
            rows.append(
                (
                    code[own][begin].astype(np.int32),
                    np.append(begin[1:], len(own)).astype(np.int32) if len(own) else begin.astype(np.int32),
                    document[own].tobytes(),
                    counts[own].astype(np.uint8).tobytes(),
                )
            )
        first = [part.column(i)[block.rows].to_pylist() for i in (0, 1, 3)]
        columns = [
            pa.array(range(SHARDS), pa.int32()),
            pa.array([number % salts] * SHARDS, pa.int32()),
            pa.array([number] * SHARDS, pa.int64()),
            pa.array([len(block)] * SHARDS, pa.int32()),
            pa.array([first[0]] + [None] * (SHARDS - 1), pa.list_(part.column(0).type)),
            pa.array([first[1]] + [None] * (SHARDS - 1), pa.list_(pa.string())),
            pa.array([first[2]] + [None] * (SHARDS - 1), pa.list_(pa.int64())),
            pa.array([r[0] for r in rows], pa.list_(pa.int32())),
            pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            pa.array([r[2] for r in rows], pa.binary()),
            pa.array([r[3] for r in rows], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["shard", "salt", "block", "size", "doc_ids", "langs", "keys", "grams", "ends", "documents", "counts"]
    schema = (
        f"shard int, salt int, block bigint, size int, doc_ids array<{kind}>, langs array<string>, keys array<bigint>, "
        "grams array<int>, ends array<int>, documents binary, counts binary"
    )
    return docs.mapInArrow(task, schema)


def perplexities(docs: DataFrame, probabilities: DataFrame, order: int) -> DataFrame:
    """(doc_id, lang, key, n_grams, surprise, error) of every row of (doc_id, lang, text, key)."""
    spark = docs.sparkSession
    salts = math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / SHARDS) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = shards(probabilities, salts).toDF("shard", "salt", "known", "surprises")
    met = lists(docs, order, salts).join(known, ["shard", "salt"], "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                yield sums(row, batch.schema.field("doc_ids").type)

    def sums(row: dict, ids_type: pa.DataType) -> pa.RecordBatch:
        size, block = row["size"].as_py(), row["block"].as_py()
        document = np.frombuffer(row["documents"].as_py(), np.uint8)
        weight = np.frombuffer(row["counts"].as_py(), np.uint8).astype(np.float64)
        partial = np.zeros((3, size))
        if len(document):
            own, ends = row["grams"].values.to_numpy(), row["ends"].values.to_numpy()
            place = np.searchsorted(row["known"].values.to_numpy(), own)
            each = row["surprises"].values.to_numpy()[place].astype(np.float64)
            each = np.repeat(each, np.diff(ends, prepend=0))
            for j, value in enumerate((weight, weight * each, weight * each * each)):
                partial[j] = np.bincount(document, value, minlength=size)
        named = row["doc_ids"].is_valid
        columns = [
            pa.array(block + np.arange(size)),
            row["doc_ids"].values if named else pa.nulls(size, ids_type.value_type),
            row["langs"].values if named else pa.nulls(size, pa.string()),
            row["keys"].values if named else pa.nulls(size, pa.int64()),
            *[pa.array(x) for x in partial],
        ]
        return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "lang", "key", "n", "s", "ss"])

    partial = met.mapInArrow(
        task, f"row bigint, doc_id {kind}, lang string, key bigint, n double, s double, ss double"
    )
    whole = partial.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("lang").alias("lang"),
        F.max("key").alias("key"),
        *[F.sum(c).alias(c) for c in ("n", "s", "ss")],
    )
    some = F.col("n") > 0
    mean = F.when(some, F.col("s") / F.col("n"))
    variance = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    return whole.select(
        "doc_id",
        "lang",
        "key",
        F.col("n").cast("long").alias("n_grams"),
        mean.alias("surprise"),
        F.when(some, F.sqrt(variance / F.col("n"))).alias("error"),
    )


def thresholds(trusted: DataFrame, rule: Rule) -> DataFrame:
    """(lang, threshold, n) from (lang, surprise) of the trusted texts; null for all.

    Read off a histogram, whose rows are bounded by the bins and the languages.
    """
    bin_ = F.floor(F.col("surprise") * rule.bins).alias("bin")
    counted = (
        trusted.filter(F.col("surprise").isNotNull())
        .groupBy(_language().alias("lang"), bin_)
        .agg(F.count("*").alias("n"))
    )
    every = counted.groupBy(F.lit(None).cast("string").alias("lang"), "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("lang")
    up_to = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.union(every)
        .withColumn("_sum", F.sum("n").over(up_to))
        .withColumn("_all", F.sum("n").over(own))
    )
    reached = F.when(F.col("_sum") >= rule.quantile * F.col("_all"), F.col("bin") + 1)
    return (
        ranked.groupBy("lang")
        .agg((F.min(reached) / rule.bins + rule.room).alias("threshold"), F.max("_all").alias("n"))
    )


def _language() -> Column:
    """The language as a key; that of null is no other's."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def _cut(trusted: DataFrame, rule: Rule) -> Column:
    """The threshold of a row's language, from (lang, surprise) of the trusted texts."""
    # One row per language.
    cuts = {r.lang: (r.n, r.threshold) for r in thresholds(trusted, rule).collect()}
    _, common = cuts.pop(None, (0, None))
    threshold = F.lit(common).cast("double")
    for lang, (n, own) in sorted(cuts.items()):
        drawn = (n * own + rule.drawn * common) / (n + rule.drawn)
        threshold = F.when(_language() == lang, drawn).otherwise(threshold)
    return threshold


def classify(
    docs: DataFrame,
    trusted_ids: DataFrame,
    rule: Rule = Rule(),
    order: int = ORDER,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, lang, n_grams, trusted, log_perplexity, threshold, word_log_perplexity,
    word_threshold, kept) of every document.

    `trusted_ids` holds the ids of trusted documents in its first column.
    """
    own = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    ids = trusted_ids.toDF("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    # Trusted texts move once, by one plan whatever their number, and are read twice.
    trusted = semi_join(own.select("doc_id", "text"), stored(ids, "trusted").hint("merge"), "doc_id")
    trusted = stored(trusted, "trusted_texts")
    model = kneser_ney.fit(kneser_ney.gram_counts(trusted, order), order)
    every = stored(kneser_ney.gram_counts(own, order).select("gram"), "grams")
    p = stored(kneser_ney.probabilities(every, model), "probabilities")
    table = perplexities(own.withColumn("key", word_model.key()), p, order)
    marked = table.join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left")
    marked = stored(marked.withColumn("trusted", F.coalesce("trusted", F.lit(False))), "perplexities")
    by_words = stored(word_model.surprises(own.select("text"), trusted.select("text")), "word_surprises")
    marked = marked.join(by_words.select("key", *[F.col(c).alias(f"_{c}") for c in by_words.columns[1:]]), "key", "left")
    # A trusted text doesn't vouch for itself.
    for c in ("surprise", "error"):
        marked = marked.withColumn(f"word_{c}", F.when(F.col("trusted"), F.col(f"_{c}_alone")).otherwise(F.col(f"_{c}")))
    marked = stored(marked.drop(*[f"_{c}" for c in by_words.columns[1:]]), "marked")
    threshold = _cut(marked.filter("trusted"), rule)
    word_threshold = _cut(marked.filter("trusted").select("lang", F.col("word_surprise").alias("surprise")), rule)
    surprise = F.col("surprise")
    above = surprise - rule.errors * F.col("error") > threshold
    word_above = F.col("word_surprise") - rule.errors * F.col("word_error") > word_threshold
    return marked.select(
        "doc_id",
        "lang",
        "n_grams",
        "trusted",
        surprise.alias("log_perplexity"),
        threshold.alias("threshold"),
        F.col("word_surprise").alias("word_log_perplexity"),
        word_threshold.alias("word_threshold"),
        (
            surprise.isNotNull() & ~F.coalesce(above, F.lit(False)) & ~F.coalesce(word_above, F.lit(False))
        ).alias("kept"),
    )
