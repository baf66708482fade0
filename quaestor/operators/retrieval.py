"""Scoring, merging and re-ranking of retrieved chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.text import query_term_hits, terms_in
from quaestor.operators.scale import first_per_key, top_per_group
from quaestor.session import cut_lineage

# Fixed format: the JSON the re-ranking model is asked for.
RANKED_SCHEMA = (
    "ranked_documents ARRAY<STRUCT<doc_id STRING, chunk_id STRING, "
    "relevance_score INT, reason STRING>>"
)


def relevance(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def fetch_by_ids(
    wanted: DataFrame, store: DataFrame, key: str = "chunk_id", order: str = "position"
) -> DataFrame:
    """Rows of `store` for the wanted ids, each once, at its first position.

    Ids the store does not hold are dropped.
    """
    first = cut_lineage(wanted.groupBy(key).agg(F.min(order).alias(order)))
    return store.join(first, key)


def with_chunks(near: DataFrame, store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Search results with the columns of `store`; chunks it lacks are dropped.

    Results are at most k rows per question. They are written first, so the
    search runs once and the big table stays where it is if they are few.
    """
    return cut_lineage(near).join(store, key)


def map_positions(found: DataFrame, index: DataFrame, pos: str = "pos") -> DataFrame:
    """Positions of a vector index to chunk ids; unknown positions are dropped."""
    return found.join(index, pos)


def score_hybrid(near: DataFrame, alpha: float = 0.7, query_id: str = "query_id") -> DataFrame:
    """Blend cosine similarity with distance relevance and rank again.

    Ranks by the rounded score, ties in first-stage order.
    """
    blended = F.lit(alpha) * F.col("similarity") + F.lit(1.0 - alpha) * relevance(F.col("distance"))
    scored = near.select(
        *[c for c in near.columns if c not in ("rank", "similarity")],
        F.round(relevance(F.col("distance")), 3).alias("relevance"),
        F.round("similarity", 3).alias("similarity"),
        F.round(blended, 4).alias("final_score"),
        F.col("rank").alias("first_rank"),
    )
    return _rank_all(scored, query_id, [F.col("final_score").desc(), F.col("first_rank")])


def score_distance(near: DataFrame) -> DataFrame:
    """Distance-only score; the first-stage rank stands."""
    return near.withColumn("final_score", F.round(relevance(F.col("distance")), 4))


def _rank_all(df: DataFrame, query_id: str, order: Sequence[Column]) -> DataFrame:
    # A question has at most the k rows its search returned, so no limit here.
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))


def keyword_search(
    questions: DataFrame,
    chunks: DataFrame,
    rules: Sequence[tuple[Sequence[str], Sequence[str]]],
    k: int = 10,
    query_id: str = "query_id",
    question: str = "question",
    id_col: str = "chunk_id",
) -> DataFrame:
    """Keyword evidence per question: (query_id, id, matched_term, position).

    `rules` pairs trigger words with the terms they expand to. Each term adds
    its first `k // terms + 1` chunks in id order, terms in rule order, and
    the first `k` of all are kept. A chunk found by two terms counts twice, as
    its matched term differs. The chunks are scanned once whatever the number
    of questions: terms are tested on each row and only matches move.
    """
    terms = list(dict.fromkeys(t.lower() for _, found in rules for t in found))
    expanded = F.flatten(
        F.array(
            *[
                F.when(
                    _contains_any(F.lower(question), triggers),
                    F.array(*[F.lit(t.lower()) for t in found]),
                ).otherwise(F.array().cast("array<string>"))
                for triggers, found in rules
            ]
        )
    )
    asked = (
        questions.select(query_id, expanded.alias("_terms"))
        .withColumn("_limit", F.floor(F.try_divide(F.lit(k), F.size("_terms"))) + 1)
        .select(query_id, "_limit", F.posexplode("_terms").alias("_term_no", "matched_term"))
        .groupBy(query_id, "_limit", "matched_term")
        .agg(F.min("_term_no").alias("_term_no"))
    )
    # Exploded at once: behind an alias Spark would also filter on the array's
    # size and work it out twice.
    hits = chunks.select(id_col, F.explode(terms_in(F.col("text"), terms)).alias("matched_term"))
    first_hits = top_per_group(hits, ["matched_term"], [F.col(id_col)], k + 1, "_hit_no")
    found = asked.join(first_hits, "matched_term").filter(F.col("_hit_no") <= F.col("_limit"))
    ordered = [F.col("_term_no"), F.col("_hit_no")]
    return top_per_group(found, [query_id], ordered, k, "position").select(
        query_id, id_col, "matched_term", "position"
    )


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    tests = [F.contains(text, F.lit(w.lower())) for w in words]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return F.coalesce(result, F.lit(False))


def hybrid_merge(
    semantic: DataFrame,
    keyword: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    id_col: str = "doc_id",
) -> DataFrame:
    """Merge semantic (with `distance`) and keyword evidence, both by `position`.

    One row per document, the semantic copy before the keyword copy. Documents
    only keywords found come first, the last found leading; then the semantic
    ones. A keyword row has distance 0.5.
    """
    both = semantic.select(
        query_id, id_col, F.lit(0).alias("_source"), "position", "distance"
    ).unionByName(
        keyword.select(
            query_id,
            id_col,
            F.lit(1).alias("_source"),
            "position",
            F.lit(None).cast("double").alias("distance"),
        )
    )
    single = first_per_key(both, [query_id, id_col], ["_source", "position"])
    order = [
        F.col("_source").desc(),
        F.when(F.col("_source") == 1, -F.col("position")).otherwise(F.col("position")),
    ]
    return top_per_group(single, [query_id], order, k).select(
        query_id,
        id_col,
        F.when(F.col("_source") == 0, "semantic").otherwise("keyword").alias("search_type"),
        F.coalesce("distance", F.lit(0.5)).alias("distance"),
        "rank",
    )


def parse_ranked(
    outputs: DataFrame,
    text: str = "output",
    query_id: str = "query_id",
    id_field: str = "doc_id",
    id_col: str = "chunk_id",
) -> DataFrame:
    """Rows of the re-ranker's JSON, in its order; malformed output gives none.

    Models put the JSON into a Markdown fence, with text around it or without:
    the first fenced block counts, else the text from the first brace to the last.
    """
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?)\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).otherwise(bare)
    ranked = F.from_json(body, RANKED_SCHEMA)["ranked_documents"]
    return outputs.select(query_id, F.posexplode(ranked).alias("output_pos", "_item")).select(
        query_id,
        F.col("_item")[id_field].alias(id_col),
        F.col("_item")["relevance_score"].alias("reranker_score"),
        F.col("_item")["reason"].alias("reranker_reason"),
        "output_pos",
    )


def rerank_merge(
    candidates: DataFrame,
    ranked: DataFrame,
    k: int = 5,
    enabled: bool = True,
    query_id: str = "query_id",
    id_col: str = "chunk_id",
) -> DataFrame:
    """The re-ranker's order first, then the candidates it left out, up to `k`.

    Ids that are no candidates are dropped, of repeated ids the first counts.
    """
    if not enabled:
        return candidates.filter(F.col("rank") <= k).select(
            query_id,
            id_col,
            F.lit(None).cast("int").alias("reranker_score"),
            F.lit(None).cast("string").alias("reranker_reason"),
            F.lit("initial").alias("source"),
            "rank",
        )
    first = first_per_key(
        ranked.filter(F.col(id_col).isNotNull()), [query_id, id_col], ["output_pos"]
    )
    merged = candidates.select(query_id, id_col, F.col("rank").alias("_first_rank")).join(
        first, [query_id, id_col], "left"
    )
    order = [F.col("output_pos").asc_nulls_last(), F.col("_first_rank")]
    return top_per_group(merged, [query_id], order, k).select(
        query_id,
        id_col,
        "reranker_score",
        "reranker_reason",
        F.when(F.col("output_pos").isNotNull(), "reranked").otherwise("initial").alias("source"),
        "rank",
    )


def keyword_rerank(
    candidates: DataFrame,
    weights: dict[str, float],
    k: int = 3,
    term_weight: float = 0.1,
    query_id: str = "query_id",
    id_col: str = "chunk_id",
) -> DataFrame:
    """Relevance plus a boost per question term in the text and per weighted word.

    Needs `question`, `text`, `relevance` and `rank`; top `k`, ties in
    candidate order.
    """
    text = F.lower("text")
    score = F.col("relevance") + F.lit(term_weight) * query_term_hits(F.col("question"), F.col("text"))
    for word, weight in weights.items():
        score = score + F.when(F.contains(text, F.lit(word)), weight).otherwise(0.0)
    scored = candidates.select(
        query_id, id_col, F.round(score, 4).alias("reranker_score"), F.col("rank").alias("_before")
    )
    order = [F.col("reranker_score").desc(), F.col("_before")]
    return top_per_group(scored, [query_id], order, k).drop("_before")


def authority_rank(candidates: DataFrame, k: int = 5, query_id: str = "query_id") -> DataFrame:
    """Order by score, then court level (1 is highest), then the newer decision."""
    order = [
        F.col("score").desc(),
        F.col("court_rank"),
        F.col("year").desc(),
        F.col("chunk_id"),
    ]
    return top_per_group(candidates, [query_id], order, k)
