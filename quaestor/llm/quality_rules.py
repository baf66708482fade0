"""Quality rules: counts of a text, and bands of its n-gram perplexity.

A modified Kneser-Ney model of the texts' symbol n-grams is counted and
estimated in Spark over all documents, then read into sorted hash arrays (its
size is bounded by the alphabet, see `symbols`) that every task searches.

The symbol model is soon full, however large the corpus. What grows with it is a
second model of all texts' words after word endings (see `word_model`), held
against bands of its own; a text is kept if it lies in the bands of both.

A document's verdict holds its mean surprise (the logarithm of its perplexity)
against the band of its language: from the lower quartile less three quartile
distances to the upper quartile plus three, over all documents that pass the
base rules. Texts far below are repetitive, texts far above are noise. The mean
of a short text is uncertain, so a text outside the band is kept if its distance
from the language's median, times the root of its length, lies in the band made
the same way of those products. A language's limits are drawn towards those of
all documents, as if 50 more documents had them, so a rare language leans on all.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts fail the base rules. A null
language is a language of its own. Repeated rows count as often as they occur;
null ids are carried. An empty table gives no rows. Only the id, text and
language columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm import kneser_ney, word_model
from quaestor.llm.stored import stored
from quaestor.llm.symbols import grams
from quaestor.llm.textops import ASCII_SPACE, BYTE_KEYS, Block, hash_runs, map_blocks, mix, windows, words

ORDER = 4
WINDOW = 5

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))


@dataclass(frozen=True)
class Bands:
    distances: float = 3.0
    drawn: float = 50.0  # documents' worth of the limits of all in a language's own
    bins: int = 1000  # of the histograms, per unit


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """The base counts of each document of a block."""
    n = len(block)
    hashes, document = words(block, lower=False)
    blank = ASCII_SPACE[block.data]
    lead = (block.data & 0xC0) != 0x80
    # Lines: runs between \n; one without a word doesn't count.
    starts, ends, line_of = block.runs(block.data != 10)
    has_word = np.append(0, np.cumsum(~blank))
    wordy = has_word[ends] > has_word[starts]
    lines = hash_runs(block.data, starts, ends)[wordy]
    own = mix(lines + BYTE_KEYS[1] * line_of[wordy].astype(np.uint64))
    _, first = np.unique(own, return_index=True)
    line_count = np.bincount(line_of[wordy], minlength=n)
    distinct = np.bincount(line_of[wordy][first], minlength=n)
    return {
        "n_words": np.bincount(document, minlength=n),
        "word_chars": block.per_document(lead & ~blank),
        "n_symbols": block.per_document(_SYMBOL[block.data]),
        "n_dup_lines": line_count - distinct,
        "n_repeat_words": _repeated(hashes, document, n),
    }


def _repeated(hashes: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Words inside windows that occur at least twice in their document."""
    found, at = windows(hashes, document, WINDOW)
    own = mix(found + BYTE_KEYS[2] * document[at].astype(np.uint64))
    order = np.argsort(own)
    ranked = own[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + WINDOW, -1)
    covered = np.cumsum(edges)[:-1] > 0
    return np.bincount(document[covered], minlength=n)


def scored(docs: DataFrame, model: kneser_ney.HashArrays, columns: tuple[str, str, str]) -> DataFrame:
    """(doc_id, lang, key, counts, base_failed, surprise, length) of every document."""
    own = docs.select(*[F.col(c).alias(a) for c, a in zip(columns, ("doc_id", "lang", "text"))])
    own = own.withColumn("key", word_model.key())
    kind = own.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        counts = base_counts(block)
        codes, offsets = grams(block, model.order)
        length = np.diff(offsets)
        total = np.append(0, np.cumsum(model.surprise(codes)))
        mean = np.diff(total[offsets]) / np.maximum(length, 1)
        n = counts["n_words"]
        failed = (n < 10) | (100 * counts["n_repeat_words"] > 20 * n)
        columns = [
            batch.column(0)[block.rows],
            batch.column(1)[block.rows],
            batch.column(3)[block.rows],
            *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
            pa.array(failed),
            pa.array(mean, mask=length == 0),
            pa.array(length.astype(np.int64)),
        ]
        names = ["doc_id", "lang", "key", *COUNTS, "base_failed", "surprise", "length"]
        return pa.RecordBatch.from_arrays(columns, names)

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return own.mapInArrow(
        lambda batches: map_blocks(batches, 2, make),
        f"doc_id {kind}, lang string, key bigint, {counts}, base_failed boolean, surprise double, length bigint",
    )


def bands(table: DataFrame, value: Column, rule: Bands) -> dict[str | None, tuple]:
    """(low, median, high) of a value per language; under None, of all.

    The quartiles are read off a histogram, whose rows are bounded by the bins
    and the languages; one row per language comes back.
    """
    of = table.filter(~F.col("base_failed") & F.col("surprise").isNotNull())
    bin_ = F.floor(value * rule.bins).alias("bin")
    counted = of.groupBy(_language().alias("lang"), bin_).agg(F.count("*").alias("n"))
    every = counted.groupBy(F.lit(None).cast("string").alias("lang"), "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("lang")
    up_to = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.union(every)
        .withColumn("_sum", F.sum("n").over(up_to))
        .withColumn("_all", F.sum("n").over(own))
    )
    at = [
        F.min(F.when(F.col("_sum") >= q * F.col("_all"), F.col("bin"))) / rule.bins
        for q in (0.25, 0.5, 0.75)
    ]
    rows = ranked.groupBy("lang").agg(F.array(*at).alias("at"), F.max("_all").alias("n")).collect()
    out = {}
    for row in rows:
        lower, middle, upper = row.at
        room = rule.distances * (upper - lower)
        out[row.lang] = (row.n, np.array([lower - room, middle, upper + room]))
    if not out:
        return {}
    common = out[None][1]
    drawn = {k: (n * own + rule.drawn * common) / (n + rule.drawn) for k, (n, own) in out.items()}
    return {k: tuple(map(float, v)) for k, v in drawn.items()}


def _language() -> Column:
    """The language as a key; that of null is no other's."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def _of_language(limits: dict[str | None, tuple], which: int) -> Column:
    """A limit by the row's language; null if there is none at all."""
    out = F.lit(limits[None][which] if None in limits else None).cast("double")
    for lang in sorted(k for k in limits if k is not None):
        out = F.when(_language() == lang, limits[lang][which]).otherwise(out)
    return out


def _inside(table: DataFrame, rule: Bands, surprise: str = "surprise", length: str = "length") -> Column:
    """Whether a surprise lies in its language's bands, which come from `surprise` and `length` of the table."""
    plain = bands(table, F.col("surprise"), rule)

    def apart(value: str, size: str) -> Column:
        return (F.col(value) - _of_language(plain, 1)) * F.sqrt(size)

    scaled = bands(table, apart("surprise", "length"), rule)
    near = F.col(surprise).between(_of_language(plain, 0), _of_language(plain, 2))
    return near | apart(surprise, length).between(_of_language(scaled, 0), _of_language(scaled, 2))


def judge(
    docs: DataFrame,
    rule: Bands = Bands(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, n_words, …, base_failed, kept, log_perplexity, word_log_perplexity) of every document."""
    counts = kneser_ney.gram_counts(docs, ORDER, text_col)
    arrays = kneser_ney.HashArrays(kneser_ney.fit(counts, ORDER))
    table = stored(scored(docs, arrays, (id_col, lang_col, text_col)), "scored")
    # Every text is in training, so what it alone holds is left out of its score.
    by_words = word_model.surprises(docs.select(F.col(text_col).alias("text")))
    by_words = by_words.select("key", F.col("words"), F.col("surprise_alone").alias("word_surprise"))
    table = stored(table.join(stored(by_words, "word_surprises"), "key", "left"), "judged")
    inside = _inside(table, rule)
    by_word = table.withColumn("surprise", F.col("word_surprise")).withColumn("length", F.col("words"))
    inside = inside & _inside(by_word, rule, "word_surprise", "words")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return table.select(
        "doc_id",
        *COUNTS,
        "base_failed",
        kept.alias("kept"),
        F.col("surprise").alias("log_perplexity"),
        F.col("word_surprise").alias("word_log_perplexity"),
    )
