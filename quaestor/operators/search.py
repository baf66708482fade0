"""Full-text search over chunks and snippet selection inside them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions.text import keyword_boost, normalized_tokens
from quaestor.functions.vectors import cosine
from quaestor.operators.scale import salted_join, top_per_group

# English stop words left out of the index.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it",
    "of", "on", "that", "the", "this", "to", "was", "with",
)


# Questions, and rows of a batch, that meet as one matrix.
QUESTION_BLOCK = 256
ROWS_AT_ONCE = 512


def text_index(
    chunks: DataFrame, id_col: str = "chunk_id", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Postings (token, id, tf), exact tokens without stemming."""
    tokens = chunks.select(id_col, F.explode(normalized_tokens(F.col("text"))).alias("token"))
    return (
        tokens.filter(~F.col("token").isin(*stop_words))
        .groupBy("token", id_col)
        .agg(F.count("*").alias("tf"))
    )


def text_search(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 10,
    mode: str = "or",
    query_id: str = "query_id",
    id_col: str = "chunk_id",
    stop_words: Sequence[str] = STOP_WORDS,
    block: int = QUESTION_BLOCK,
) -> DataFrame:
    """Best `k` chunks by the sum of tf * ln(chunks / df) over question tokens.

    `mode` "and" wants every question token that is not a stop word. The
    questions are a stated set: their tokens ride to the tasks. A first scan
    counts the chunks that hold each asked token, a second one scores every
    text where it lies, and a task gives up its best `k` per question. No
    posting moves, so a token that is in every text costs no more than others.
    Scores are rounded to six places, ties go to the smaller id.
    """
    tokens = chunks.select(id_col, normalized_tokens(F.col("text")).alias("tokens"))
    terms = F.array_distinct(normalized_tokens(F.col("question")))
    stops = F.array(*[F.lit(w) for w in stop_words])
    asked = questions.select(query_id, F.array_except(terms, stops).alias("terms")).toArrow()
    schema = T.StructType(
        [
            T.StructField(query_id, questions.schema[query_id].dataType),
            T.StructField(id_col, chunks.schema[id_col].dataType),
            T.StructField("matched", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    found = chunks.sparkSession.createDataFrame([], schema)
    vocabulary = asked.column("terms").combine_chunks().flatten().unique()
    if len(vocabulary):
        idf = _inverse_frequencies(tokens, vocabulary)
        for at in range(0, asked.num_rows, block):
            part = asked.slice(at, block)
            found = found.union(_score(tokens, part, vocabulary, idf, schema, k, mode))
    order = [F.col("score").desc(), F.col(id_col)]
    return top_per_group(found, [query_id], order, k)


def _inverse_frequencies(tokens: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """ln(chunks / chunks with the token) of each asked token; 0 if none has it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            row, term = _asked(batch.column(1), vocabulary)
            seen = np.unique(row * len(vocabulary) + term) % len(vocabulary)
            held[:-1] += np.bincount(seen, minlength=len(vocabulary))
            rows += len(batch)
        held[-1] = rows
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(held[term])], ["term", "n"])

    counted = tokens.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    # A row per asked token, and one for all chunks.
    n = {r["term"]: r["n"] for r in counted.collect()}
    total = n.get(len(vocabulary), 0)
    return np.array([math.log(total / n[t]) if t in n else 0.0 for t in range(len(vocabulary))])


def _asked(lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every token of the lists that is asked for."""
    lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy()
    term = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy()
    row = np.repeat(np.arange(len(lists)), lengths)
    return row[term >= 0], term[term >= 0].astype(np.int64)


def _score(
    tokens: DataFrame,
    asked: pa.Table,
    vocabulary: pa.Array,
    idf: np.ndarray,
    schema: T.StructType,
    k: int,
    mode: str,
) -> DataFrame:
    """The best `k` chunks that each task finds for a block of questions."""
    lists = asked.column("terms").combine_chunks()
    question, term = _asked(lists, vocabulary)
    weight = np.zeros((len(vocabulary), len(lists)))
    weight[term, question] = idf[term]
    wants = np.zeros((len(vocabulary), len(lists)), np.float32)
    wants[term, question] = 1
    wanted = wants.sum(axis=0)
    keys = asked.column(0).combine_chunks()
    names = [f.name for f in schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                row, own = _asked(part.column(1), vocabulary)
                tf = np.zeros((len(part), len(vocabulary)))
                np.add.at(tf, (row, own), 1)
                matched = (tf > 0).astype(np.float32) @ wants
                hit = matched == wanted if mode == "and" else matched > 0
                row, asker = np.nonzero(hit & (matched > 0))
                score = np.round(tf @ weight, 6)[row, asker]
                ids = part.column(0).take(pa.array(row))
                new = pa.table([keys.take(pa.array(asker)), ids, pa.array(matched[row, asker].astype(np.int64)), pa.array(score), pa.array(asker)], [*names, "_asker"])
                best = new if best is None else pa.concat_tables([best, new])
                best = _first_per_question(best, names[1], k)
        if best is not None:
            yield from best.drop_columns("_asker").to_batches()

    return tokens.mapInArrow(scan, schema)


def _first_per_question(table: pa.Table, id_col: str, k: int) -> pa.Table:
    order = [("_asker", "ascending"), ("score", "descending"), (id_col, "ascending")]
    table = table.sort_by(order)
    asker = table.column("_asker").to_numpy()
    nth = np.arange(len(asker)) - np.searchsorted(asker, asker)
    return table.filter(pa.array(nth < k))


def select_snippets(
    pairs: DataFrame,
    snippets: DataFrame,
    questions: DataFrame,
    k: int = 3,
    boost: Callable[[Column, Column], Column] = keyword_boost,
    separator: str = "\n\n---\n\n",
    query_id: str = "query_id",
    id_col: str = "chunk_id",
    whole: DataFrame | None = None,
) -> DataFrame:
    """The `k` snippets of each (question, chunk) nearest to the question.

    A pair whose chunk has no snippet stays, with the chunk's text from `whole`
    (id, text) or else null, and no score.

    `snippets` holds (id, snippet_no, snippet, snippet_embedding); `boost` makes
    a score of the snippet's text and similarity. Only numbers take part in the
    ranking; the texts of the winners are joined at the end. One chunk may own
    many snippets, hence the salt.
    """
    vectors = questions.select(query_id, F.col("embedding").alias("_question"))
    asked = pairs.join(vectors, query_id)
    similarity = cosine(F.col("_question"), F.col("snippet_embedding"))
    scored = salted_join(snippets, asked, [id_col], "inner", spread=["snippet_no"]).select(
        query_id,
        id_col,
        "snippet_no",
        boost(F.col("snippet"), similarity).alias("score"),
    )
    best = top_per_group(
        scored, [query_id, id_col], [F.col("score").desc(), F.col("snippet_no")], k
    )
    texts = best.join(snippets.select(id_col, "snippet_no", "snippet"), [id_col, "snippet_no"])
    found = texts.groupBy(query_id, id_col).agg(
        F.count("*").alias("snippets"),
        F.round(F.max("score"), 6).alias("best_score"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "snippet"))), lambda s: s["snippet"]
            ),
            separator,
        ).alias("snippet"),
    )
    result = pairs.select(query_id, id_col).join(found, [query_id, id_col], "left")
    if whole is not None:
        texts = whole.select(id_col, F.col("text").alias("_whole"))
        result = result.join(texts, id_col, "left").withColumn("snippet", F.coalesce("snippet", "_whole"))
    return result.select(
        query_id, id_col, F.coalesce("snippets", F.lit(0)).alias("snippets"), "best_score", "snippet"
    )
