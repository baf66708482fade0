"""Frames and SQL fragments that several queries share.

The standard tables play these roles: `benchmark` holds the questions,
`embeddings` the vectors of the chunks, `documents` their texts (joined on
vec_id = doc_id). A question is about the topic `item_id mod 10` and its vector
is the mean vector of that topic, so every row of every table takes part.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators.knn import knn
from quaestor.plans.registry import table

TOPICS = 10

# Trigger words and the terms they expand to, chosen from the
# vocabulary of the test texts.
KEYWORD_RULES = [
    (["hein"], ["hein", "therble", "anti"]),
    (["inin", "erth"], ["inin", "eronth", "hand", "thes"]),
    (["que"], ["queau", "tionle", "vien"]),
    (["thon"], ["thon", "reer", "estion"]),
]

# Words with a weight of their own in the keyword re-ranking.
BOOST_WEIGHTS = {"thre": 0.2, "estion": 0.3, "inin": 0.1}


def topic_vectors(vectors: DataFrame) -> DataFrame:
    """Mean vector per label; a map task ships one sum per label."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return vectors.groupBy("label").agg(vector_to_array(mean).alias("embedding"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, question, label, embedding)"""
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("question"),
        F.pmod("item_id", F.lit(TOPICS)).cast("int").alias("label"),
    )
    return asked.join(topic_vectors(table(spark, folder, "embeddings")), "label")


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, embedding, label)"""
    return table(spark, folder, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, text)"""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def candidates(spark: SparkSession, folder: str, k: int = 20, metric: str = "l2") -> DataFrame:
    """First-stage neighbours of every question."""
    return knn(questions(spark, folder), chunk_vectors(spark, folder), k, metric=metric)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def epoch_seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


CENTROIDS_SQL = """
centroids AS (
  SELECT label, list(x ORDER BY i) AS embedding
  FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x
        FROM embeddings, range(1, len(embedding) + 1) AS r(i) GROUP BY label, i)
  GROUP BY label),
questions AS (
  SELECT item_id AS query_id, text AS question, c.label, c.embedding
  FROM benchmark b JOIN centroids c ON c.label = b.item_id % 10)"""

PAIRS_SQL = (
    CENTROIDS_SQL
    + """,
pairs AS (
  SELECT q.query_id, e.vec_id AS chunk_id,
         list_distance(q.embedding, e.embedding::DOUBLE[]) ** 2 AS distance,
         list_cosine_similarity(q.embedding, e.embedding::DOUBLE[]) AS similarity
  FROM questions q CROSS JOIN embeddings e),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
  FROM pairs QUALIFY rank <= 20)"""
)

HYBRID_SQL = (
    PAIRS_SQL
    + """,
hybrid AS (
  SELECT query_id, chunk_id, relevance, similarity, final_score,
         row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS rank
  FROM (SELECT n.query_id, n.chunk_id, n.rank,
               round(1 / (1 + n.distance), 3) AS relevance,
               round(n.similarity, 3) AS similarity,
               round(0.7::DOUBLE * n.similarity + (1 - 0.7::DOUBLE) / (1 + n.distance), 4) AS final_score
        FROM near n JOIN documents d ON d.doc_id = n.chunk_id))"""
)
