"""Retrieval queries: neighbours, hybrid scores, merges and re-ranking."""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import text as tx
from quaestor.functions import vectors as vx
from quaestor.operators import knn as nn
from quaestor.operators import retrieval as rt
from quaestor.operators import vector_index
from quaestor.operators.chunking import chunk_fixed
from quaestor.operators.ingest import vector_positions
from quaestor.operators.search import select_snippets
from quaestor.plans import common as cm
from quaestor.plans.registry import documents, query, table
from quaestor.session import cut_lineage, shared_folder


@query(
    "knn_l2",
    f"""WITH {cm.PAIRS_SQL}
SELECT query_id, chunk_id, round(distance, 6) AS distance,
       row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
FROM pairs WHERE chunk_id % 11 NOT IN (3, 4, 5, 6) QUALIFY rank <= 20""",
)
def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    """Exact neighbours in a corpus with short, long, broken and missing vectors."""
    kind, vector = F.col("chunk_id") % 11, F.col("embedding")
    flawed = (
        F.when(kind == 3, F.slice(vector, 1, 16))
        .when(kind == 4, F.concat(vector, vector))
        .when(kind == 5, F.concat(F.slice(vector, 2, 100), F.array(F.lit(None).cast("float"))))
        .when(kind != 6, vector)
    )
    corpus = cm.chunk_vectors(spark, folder).withColumn("embedding", flawed)
    return nn.knn(cm.questions(spark, folder), corpus, 20).select(
        "query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank"
    )


@query(
    "cosine_topk",
    f"""WITH {cm.PAIRS_SQL}
SELECT query_id, chunk_id, round(similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
FROM pairs QUALIFY rank <= 20""",
)
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    return cm.candidates(spark, folder, metric="cosine").select(
        "query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), "rank"
    )


def hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """Scored candidates with their texts; chunks without a text are dropped."""
    near = rt.with_chunks(cm.candidates(spark, folder), cm.chunk_texts(spark, folder))
    return rt.score_hybrid(near)


@query(
    "hybrid_score",
    f"""WITH {cm.HYBRID_SQL}
SELECT query_id, chunk_id, relevance, similarity, final_score, rank FROM hybrid""",
)
def hybrid_score(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid(spark, folder).select(
        "query_id", "chunk_id", "relevance", "similarity", "final_score", "rank"
    )


@query(
    "distance_score",
    f"""WITH {cm.PAIRS_SQL}
SELECT query_id, chunk_id, round(1 / (1 + distance), 4) AS final_score, rank FROM near""",
)
def distance_score(spark: SparkSession, folder: str) -> DataFrame:
    return rt.score_distance(cm.candidates(spark, folder)).select(
        "query_id", "chunk_id", "final_score", "rank"
    )


def ivf(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    """Neighbours among the four nearest of ten cells, read from a folder per cell.

    The topics' mean vectors serve as centroids, so SQL can name the cells; the
    tests train centroids and measure recall.
    """
    corpus = cm.chunk_vectors(spark, folder).select("chunk_id", "embedding", "label")
    # One row per topic.
    means = cm.topic_vectors(corpus).orderBy("label").collect()
    centroids = np.array([row["embedding"] for row in means])
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    nn.write_ivf(corpus.drop("label"), centroids, path, metric=metric)
    cells = spark.read.parquet(path)
    found = nn.ivf_knn(
        cm.questions(spark, folder), cells, centroids, 20, probes=4, metric=metric
    )
    return found.select(
        "query_id",
        "chunk_id",
        F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"),
        "rank",
    )


def ivf_sql(metric: str) -> str:
    near = "-list_cosine_similarity(v, c.embedding)" if metric == "cosine" else "list_distance(v, c.embedding)"
    best = "similarity DESC" if metric == "cosine" else "distance"
    return f"""WITH {cm.PAIRS_SQL},
placed AS (SELECT vec_id AS chunk_id, c.label AS cell, e.embedding::DOUBLE[] AS v,
  row_number() OVER (PARTITION BY vec_id ORDER BY {near}, c.label) AS n FROM embeddings e, centroids c),
probed AS (SELECT query_id, c.label AS cell, q.embedding AS v,
  row_number() OVER (PARTITION BY query_id ORDER BY {near}, c.label) AS n FROM questions q, centroids c)
SELECT p.query_id, p.chunk_id, round(p.distance, 6) AS distance, round(p.similarity, 6) AS similarity,
       row_number() OVER (PARTITION BY p.query_id ORDER BY p.{best}, p.chunk_id) AS rank
FROM pairs p JOIN placed a ON a.chunk_id = p.chunk_id AND a.n = 1
JOIN probed b ON b.query_id = p.query_id AND b.cell = a.cell AND b.n <= 4
QUALIFY rank <= 20"""


@query("ivf_knn", ivf_sql("l2"))
def ivf_knn(spark: SparkSession, folder: str) -> DataFrame:
    return ivf(spark, folder, "l2")


@query("ivf_knn_cosine", ivf_sql("cosine"))
def ivf_knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return ivf(spark, folder, "cosine")


# Every twentieth row asks for its ten nearest of all rows. Half of the rows are
# in the index when it is trained, the others are appended.
@query(
    "ivf_recall",
    """SELECT count(*) AS indexed, count(*) FILTER (vec_id % 20 = 0) AS questions,
       10 * count(*) FILTER (vec_id % 20 = 0) AS neighbours, true AS enough FROM embeddings""",
)
def ivf_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of a trained, appended index against the exact neighbours; 0.9 is enough."""
    rows = cm.chunk_vectors(spark, folder).select("chunk_id", "embedding")
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    vector_index.build(rows.filter("chunk_id % 2 = 0"), path, lists=32, largest=20_000)
    vector_index.append(rows.filter("chunk_id % 2 = 1"), path)
    asked = rows.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    found = vector_index.search(spark, path, asked, 10, probes=16)
    recall = nn.recall_at_k(found, nn.knn(asked, rows, 10))
    indexed = spark.read.parquet(f"{path}/cells").agg(F.count("*").alias("indexed"))
    return recall.agg(
        F.count("*").alias("questions"),
        (10 * F.count("*")).alias("neighbours"),
        (F.avg("recall") >= 0.9).alias("enough"),
        F.lit(indexed.first().indexed).alias("indexed"),
    )




@query(
    "l2_normalize",
    """WITH v AS (
  SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
  FROM embeddings)
SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE / norm, 6) + 0.0::DOUBLE AS value
FROM v, range(1, len(embedding) + 1) AS r(i) WHERE norm > 0""",
)
def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    unit = vx.l2_normalize(F.col("embedding"))
    return (
        table(spark, folder, "embeddings")
        .select("vec_id", F.posexplode(unit).alias("pos", "value"))
        .select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("value", 6) + 0.0).alias("value"))
    )


@query(
    "vec_index",
    """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id AS chunk_id
FROM embeddings WHERE embedding IS NOT NULL""",
)
def vec_index(spark: SparkSession, folder: str) -> DataFrame:
    return vector_positions(cm.chunk_vectors(spark, folder)).select("pos", "chunk_id")


@query(
    "pos_map_join",
    """WITH idx AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id AS chunk_id
  FROM embeddings WHERE embedding IS NOT NULL),
found AS (SELECT doc_id AS pos, lang FROM documents)
SELECT f.pos, f.lang, idx.chunk_id FROM found f JOIN idx ON idx.pos = f.pos""",
)
def pos_map_join(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select(F.col("doc_id").alias("pos"), "lang")
    index = vector_positions(cm.chunk_vectors(spark, folder))
    return rt.map_positions(found, index)


@query(
    "fetch_by_ids",
    """WITH wanted AS (SELECT chunk_id, min(position) AS position
  FROM (SELECT doc_id AS chunk_id, 2 * doc_id AS position FROM labels
        UNION ALL SELECT vec_id, vec_id + 100 FROM embeddings) GROUP BY chunk_id)
SELECT w.chunk_id, d.n_chars, w.position FROM wanted w JOIN documents d ON d.doc_id = w.chunk_id""",
)
def fetch_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "labels").select(
        F.col("doc_id").alias("chunk_id"), (F.col("doc_id") * 2).alias("position")
    )
    embedded = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") + 100).alias("position")
    )
    store = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    return rt.fetch_by_ids(labelled.unionAll(embedded), store).select(
        "chunk_id", "n_chars", "position"
    )


def _keyword_sql(k: int) -> str:
    rules = " UNION ALL ".join(
        f"SELECT {r} AS rule, {t} AS term_no, '{term}' AS term, "
        + "["
        + ", ".join(f"'{w}'" for w in triggers)
        + "] AS triggers"
        for r, (triggers, terms) in enumerate(cm.KEYWORD_RULES)
        for t, term in enumerate(terms)
    )
    return f"""
rules AS ({rules}),
asked AS (
  SELECT b.item_id AS query_id, r.term, min(r.rule * 100 + r.term_no) AS term_no,
         any_value(n.n) AS n
  FROM benchmark b
  JOIN rules r ON len(list_filter(r.triggers, lambda w: contains(lower(b.text), w))) > 0
  JOIN (SELECT b.item_id, count(*) AS n FROM benchmark b JOIN rules r
        ON len(list_filter(r.triggers, lambda w: contains(lower(b.text), w))) > 0
        GROUP BY b.item_id) n ON n.item_id = b.item_id
  GROUP BY b.item_id, r.term),
hits AS (
  SELECT t.term, d.doc_id, row_number() OVER (PARTITION BY t.term ORDER BY d.doc_id) AS hit_no
  FROM (SELECT DISTINCT term FROM rules) t JOIN documents d ON contains(lower(d.text), t.term)),
keyword AS (
  SELECT a.query_id, h.doc_id, a.term AS matched_term,
         row_number() OVER (PARTITION BY a.query_id ORDER BY a.term_no, h.hit_no) AS position
  FROM asked a JOIN hits h ON h.term = a.term AND h.hit_no <= {k} // a.n + 1
  QUALIFY position <= {k})"""


def keyword_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    docs = documents(spark, folder, "text")
    return rt.keyword_search(asked, docs, cm.KEYWORD_RULES, k, id_col="doc_id")


@query(
    "keyword_search",
    f"WITH {_keyword_sql(10)} SELECT query_id, doc_id, matched_term, position FROM keyword",
)
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_hits(spark, folder, 10)


HYBRID_MERGE_SQL = (
    cm.PAIRS_SQL
    + ","
    + _keyword_sql(5)
    + """,
both_sources AS (
  SELECT query_id, chunk_id AS doc_id, 0 AS source, rank AS position, distance FROM near WHERE rank <= 10
  UNION ALL
  SELECT query_id, doc_id, 1, position, NULL FROM keyword),
single AS (
  SELECT * FROM both_sources
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY source, position) = 1),
merged AS (
  SELECT query_id, doc_id, CASE source WHEN 0 THEN 'semantic' ELSE 'keyword' END AS search_type,
         coalesce(distance, 0.5) AS distance,
         row_number() OVER (PARTITION BY query_id ORDER BY source DESC,
           CASE source WHEN 1 THEN -position ELSE position END) AS rank
  FROM single QUALIFY rank <= 5)"""
)


def merged_evidence(spark: SparkSession, folder: str) -> DataFrame:
    semantic = cm.candidates(spark, folder, k=10).select(
        "query_id", F.col("chunk_id").alias("doc_id"), "distance", F.col("rank").alias("position")
    )
    return rt.hybrid_merge(semantic, keyword_hits(spark, folder, 5))


@query(
    "hybrid_merge",
    f"""WITH {HYBRID_MERGE_SQL}
SELECT query_id, doc_id, search_type, round(distance, 6) AS distance, rank FROM merged""",
)
def hybrid_merge(spark: SparkSession, folder: str) -> DataFrame:
    return merged_evidence(spark, folder).withColumn("distance", F.round("distance", 6))


# The stand-in for the re-ranking model names every second candidate, last one
# first, after an id nobody asked for and before a repeat of the last one. The
# answers for topic 3 are malformed and those for topic 4 sit in a code fence.
RERANK_SQL = (
    cm.HYBRID_SQL
    + """,
items AS (
  SELECT query_id, string_agg('{"doc_id": "' || chunk_id || '", "relevance_score": ' || (1 + rank % 5)
           || ', "reason": "r' || rank || '"}', ', ' ORDER BY rank DESC) AS body,
         min(chunk_id) AS again
  FROM hybrid WHERE rank % 2 = 1 GROUP BY query_id),
model AS (
  SELECT i.query_id, CASE q.label
      WHEN 3 THEN 'no json here'
      WHEN 4 THEN '```json' || chr(10) || j || chr(10) || '```'
      ELSE j END AS output
  FROM (SELECT query_id, '{"ranked_documents": [{"doc_id": "x-1", "relevance_score": 5, "reason": "?"}, '
          || body || ', {"doc_id": "' || again || '", "relevance_score": 1, "reason": "again"}]}' AS j
        FROM items) i JOIN questions q ON q.query_id = i.query_id),
parsed AS (
  SELECT query_id, pos - 1 AS output_pos, json_extract_string(j, '$.ranked_documents[' || (pos - 1) || '].doc_id') AS chunk_id,
         json_extract(j, '$.ranked_documents[' || (pos - 1) || '].relevance_score')::INT AS reranker_score,
         json_extract_string(j, '$.ranked_documents[' || (pos - 1) || '].reason') AS reranker_reason
  FROM (SELECT query_id, regexp_replace(regexp_replace(output, '^```(json)?\\s*', ''), '\\s*```$', '') AS j FROM model) m,
       range(1, CASE WHEN json_valid(j) THEN json_array_length(j, '$.ranked_documents')::BIGINT ELSE 0 END + 1) AS r(pos))"""
)


def model_outputs(spark: SparkSession, folder: str, scored: DataFrame) -> DataFrame:
    """(query_id, output): a table of re-ranker answers made from the candidates."""
    item = F.format_string(
        '{"doc_id": "%d", "relevance_score": %d, "reason": "r%d"}',
        "chunk_id", 1 + F.col("rank") % 5, "rank",
    )
    listed = (
        scored.filter(F.col("rank") % 2 == 1)
        .groupBy("query_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("rank", item.alias("item"))), asc=False).alias("items"),
            F.min("chunk_id").alias("again"),
        )
    )
    body = F.concat(
        F.lit('{"ranked_documents": [{"doc_id": "x-1", "relevance_score": 5, "reason": "?"}, '),
        F.array_join(F.transform("items", lambda i: i["item"]), ", "),
        F.format_string(', {"doc_id": "%d", "relevance_score": 1, "reason": "again"}]}', "again"),
    )
    topic = F.pmod("query_id", F.lit(cm.TOPICS))
    return listed.select(
        "query_id",
        F.when(topic == 3, F.lit("no json here"))
        .when(topic == 4, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(topic == 5, F.concat(F.lit("\n\n```\n"), body, F.lit("\n```\n")))
        .when(topic == 6, F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```\nBye.")))
        .when(topic == 7, F.concat(F.lit("```JSON "), body, F.lit("```")))
        .when(topic == 8, F.concat(F.lit("The answer is "), body, F.lit(".")))
        .otherwise(body)
        .alias("output"),
    )


@query(
    "rerank_parse",
    f"""WITH {RERANK_SQL}
SELECT query_id, output_pos, chunk_id, reranker_score, reranker_reason FROM parsed""",
)
def rerank_parse(spark: SparkSession, folder: str) -> DataFrame:
    return rt.parse_ranked(model_outputs(spark, folder, hybrid(spark, folder)))


@query(
    "rerank_merge",
    f"""WITH {RERANK_SQL},
first AS (SELECT * FROM parsed
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY output_pos) = 1),
merged AS (SELECT h.query_id, h.chunk_id, f.reranker_score, f.reranker_reason,
       CASE WHEN f.output_pos IS NULL THEN 'initial' ELSE 'reranked' END AS source,
       row_number() OVER (PARTITION BY h.query_id ORDER BY f.output_pos NULLS LAST, h.rank) AS final_rank
FROM hybrid h LEFT JOIN first f ON f.query_id = h.query_id AND f.chunk_id = h.chunk_id::VARCHAR)
SELECT * EXCLUDE (final_rank), final_rank AS rank FROM merged WHERE final_rank <= 5""",
)
def rerank_merge(spark: SparkSession, folder: str) -> DataFrame:
    scored = hybrid(spark, folder)
    ranked = rt.parse_ranked(model_outputs(spark, folder, scored))
    typed = ranked.withColumn("chunk_id", F.expr("try_cast(chunk_id AS BIGINT)"))
    return rt.rerank_merge(scored, typed)


@query(
    "keyword_rerank",
    f"""WITH {cm.HYBRID_SQL},
scored AS (
  SELECT h.query_id, h.chunk_id, h.rank AS first_rank, round(h.relevance
      + 0.1::DOUBLE * len(list_filter(list_distinct(list_filter(string_split_regex(lower(q.question), '\\s+'), lambda w: w <> '')),
                                      lambda w: contains(lower(d.text), w)))
      + CASE WHEN contains(lower(d.text), 'thre') THEN 0.2::DOUBLE ELSE 0 END
      + CASE WHEN contains(lower(d.text), 'estion') THEN 0.3::DOUBLE ELSE 0 END
      + CASE WHEN contains(lower(d.text), 'inin') THEN 0.1::DOUBLE ELSE 0 END, 4) AS reranker_score
  FROM hybrid h JOIN questions q ON q.query_id = h.query_id JOIN documents d ON d.doc_id = h.chunk_id)
SELECT query_id, chunk_id, reranker_score,
       row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, first_rank) AS rank
FROM scored QUALIFY rank <= 3""",
)
def keyword_rerank(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    return rt.keyword_rerank(hybrid(spark, folder).join(asked, "query_id"), cm.BOOST_WEIGHTS)


@query(
    "authority_rank",
    f"""WITH {cm.PAIRS_SQL}
SELECT * EXCLUDE (final_rank), final_rank AS rank FROM (
SELECT n.query_id, n.chunk_id, e.label % 5 + 1 AS score, n.chunk_id % 3 + 1 AS court_rank,
       2000 + n.chunk_id % 20 AS year,
       row_number() OVER (PARTITION BY n.query_id
         ORDER BY e.label % 5 DESC, n.chunk_id % 3, n.chunk_id % 20 DESC, n.chunk_id) AS final_rank
FROM near n JOIN embeddings e ON e.vec_id = n.chunk_id) WHERE final_rank <= 5""",
)
def authority_rank(spark: SparkSession, folder: str) -> DataFrame:
    facts = cm.chunk_vectors(spark, folder).select(
        "chunk_id",
        (F.col("label") % 5 + 1).alias("score"),
        (F.col("chunk_id") % 3 + 1).alias("court_rank"),
        (F.col("chunk_id") % 20 + 2000).alias("year"),
    )
    near = rt.with_chunks(cm.candidates(spark, folder).select("query_id", "chunk_id"), facts)
    return rt.authority_rank(near).select(
        "query_id", "chunk_id", "score", "court_rank", "year", "rank"
    )


CONTEXT_LINE = "'### Document ID: ' || h.chunk_id || chr(10) || 'Content:' || chr(10) ||"


@query(
    "context_assemble",
    f"""WITH {cm.HYBRID_SQL}
SELECT h.query_id, 'Context:' || chr(10) || string_agg({CONTEXT_LINE}
         CASE WHEN length(d.text) > 500 THEN d.text[1:500] || '...' ELSE d.text END,
         chr(10) || chr(10) ORDER BY h.rank) || chr(10) || 'Question: ' || any_value(q.question) AS prompt
FROM hybrid h JOIN documents d ON d.doc_id = h.chunk_id JOIN questions q ON q.query_id = h.query_id
WHERE h.rank <= 5 GROUP BY h.query_id""",
)
def context_assemble(spark: SparkSession, folder: str) -> DataFrame:
    best = hybrid(spark, folder).filter(F.col("rank") <= 5)
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    prompt = tx.fill_prompt(
        "Context:\n{context}\nQuestion: {question}",
        context=F.col("context"),
        question=F.col("question"),
    )
    return tx.assemble_context(best).join(asked, "query_id").select(
        "query_id", prompt.alias("prompt")
    )


# A chunk's snippets are windows of 512 characters with 50 of overlap; their
# vectors are the chunk's vector turned by the snippet number, which stands in
# for an embedding model in both engines.
@query(
    "snippet_topk",
    f"""WITH {cm.HYBRID_SQL},
best AS (SELECT h.query_id, h.chunk_id, d.text, e.embedding AS v, q.embedding AS qv
  FROM hybrid h JOIN documents d ON d.doc_id = h.chunk_id JOIN embeddings e ON e.vec_id = h.chunk_id
  JOIN questions q ON q.query_id = h.query_id),
pieces AS (SELECT query_id, chunk_id, i AS snippet_no, text[i * 462 + 1 : i * 462 + 512] AS snippet,
    qv, v[i % 64 + 1 :] || v[: i % 64] AS sv
  FROM best, range(0, greatest(1, ceil((length(text) - 512) / 462.0)::BIGINT + 1)) AS r(i)
  WHERE chunk_id % 7 <> 3),
scored AS (SELECT query_id, chunk_id, snippet_no, snippet,
    list_cosine_similarity(qv, sv::DOUBLE[]) * CASE WHEN contains(lower(replace(snippet, ' ', '')), 'inin') THEN 1.5::DOUBLE ELSE 1 END AS score
  FROM pieces),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, snippet_no) AS rank
  FROM scored QUALIFY rank <= 3)
SELECT query_id, chunk_id, count(*) AS snippets, round(max(score), 6) AS best_score,
       string_agg(snippet, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS snippet
FROM kept GROUP BY query_id, chunk_id
UNION ALL SELECT query_id, chunk_id, 0, NULL, '' FROM best WHERE chunk_id % 7 = 3""",
)
def snippet_topk(spark: SparkSession, folder: str) -> DataFrame:
    # Candidates first: only their texts are cut into snippets.
    pairs = cut_lineage(hybrid(spark, folder).select("query_id", "chunk_id"))
    # Every seventh text is taken to be blank and has no snippet.
    text = F.when(F.col("doc_id") % 7 == 3, "").otherwise(F.col("text")).alias("text")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), text)
    docs = docs.join(pairs, "chunk_id", "left_semi")
    vectors = cm.chunk_vectors(spark, folder).select("chunk_id", "embedding")
    turned = F.concat(
        F.slice("embedding", F.col("turn") + 1, F.size("embedding")),
        F.slice("embedding", 1, F.col("turn")),
    )
    snippets = (
        chunk_fixed(docs.join(vectors, "chunk_id"), 512, 50, id_col="chunk_id")
        .withColumn("turn", F.col("chunk_no") % 64)
        .select(
            "chunk_id",
            F.col("chunk_no").alias("snippet_no"),
            F.col("text").alias("snippet"),
            turned.alias("snippet_embedding"),
        )
    )
    asked = cm.questions(spark, folder).select("query_id", "embedding")
    boost = partial(tx.keyword_boost, keyword="inin")
    return select_snippets(pairs, cut_lineage(snippets), asked, boost=boost, whole=docs)
