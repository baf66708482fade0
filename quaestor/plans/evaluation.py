"""Evaluation queries: retrieval metrics, answer quality and the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import vectors as vx
from quaestor.operators import evaluate as ev
from quaestor.functions.text import words
from quaestor.plans import common as cm
from quaestor.plans.registry import query, table
from quaestor.plans.retrieval import HYBRID_MERGE_SQL, merged_evidence
from quaestor.plans.text import PAIRS_SQL, WORDS_SQL, embed, hashed, turn_pairs
from quaestor.session import cut_lineage

# Words of the test texts in place of the legal defaults.
TERMS = ("therble", "estion", "inin", "que", "hein", "tion", "der")
MARKERS = ("Que ", "The ", "Der ")
STYLE = ("and", "les", "que", "und")
CITED = r"de [^.]+\."


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# A question on a topic wants documents of that topic or of the third after
# it; the last pattern occurs inside ids only and must not match.
TRUTH_SQL = """truth AS (SELECT query_id, question, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS domain,
  'level ' || (label % 3) AS difficulty,
  ['L' || label || '_.*', 'L' || ((label + 3) % 10) || '_1|Z', '_.*'] AS doc_patterns FROM questions)"""

RETRIEVAL_SQL = (
    HYBRID_MERGE_SQL
    + ","
    + TRUTH_SQL
    + """,
retrieved AS (SELECT m.query_id, 'L' || e.label || '_' || m.doc_id AS doc_id, m.rank
  FROM merged m JOIN embeddings e ON e.vec_id = m.doc_id),
listed AS (SELECT query_id, list(doc_id ORDER BY rank) AS docs FROM retrieved GROUP BY query_id),
judged AS (SELECT t.query_id, t.doc_patterns, coalesce(l.docs, []) AS docs,
  len(list_filter(t.doc_patterns, lambda p: len(list_filter(coalesce(l.docs, []), lambda d: regexp_matches(d, '^(?:' || p || ')'))) > 0)) AS found,
  list_transform(coalesce(l.docs, []), lambda d: len(list_filter(t.doc_patterns, lambda p: regexp_matches(d, '^(?:' || p || ')'))) > 0) AS ok
  FROM truth t LEFT JOIN listed l ON l.query_id = t.query_id),
retrieval AS (SELECT query_id, docs, found AS relevant_found, len(doc_patterns) AS total_relevant, len(docs) AS retrieved_count,
  CASE WHEN len(docs) > 0 THEN found / len(docs) ELSE 0 END AS precision_at_k,
  found / len(doc_patterns) AS recall_at_k,
  CASE WHEN found > 0 THEN 2 * (found / len(docs)) * (found / len(doc_patterns)) / (found / len(docs) + found / len(doc_patterns)) ELSE 0 END AS f1_at_k,
  CASE WHEN list_position(ok, true) > 0 THEN 1 / list_position(ok, true) ELSE 0 END AS mrr,
  CASE WHEN len(docs) > 0 THEN len(list_filter(ok, lambda o: o)) / len(docs) ELSE 0 END AS precision_docs
  FROM judged)"""
)


def truth(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label")
    other = F.pmod(label + 3, F.lit(cm.TOPICS)).cast("string")
    return cm.questions(spark, folder).select(
        "query_id",
        "question",
        F.when(label % 2 == 0, "even").otherwise("odd").alias("domain"),
        F.concat(F.lit("level "), (label % 3).cast("string")).alias("difficulty"),
        F.array(
            F.concat(F.lit("L"), label.cast("string"), F.lit("_.*")),
            F.concat(F.lit("L"), other, F.lit("_1|Z")),
            F.lit("_.*"),
        ).alias("doc_patterns"),
    )


def retrieval(spark: SparkSession, folder: str) -> DataFrame:
    labels = cm.chunk_vectors(spark, folder).select(F.col("chunk_id").alias("doc_id"), "label")
    named = F.concat(F.lit("L"), F.col("label").cast("string"), F.lit("_"), F.col("doc_id").cast("string"))
    retrieved = merged_evidence(spark, folder).join(labels, "doc_id").select(
        "query_id", named.alias("doc_id"), "rank"
    )
    return ev.evaluate_retrieval(retrieved, truth(spark, folder))


@query(
    "eval_retrieval",
    f"""WITH {RETRIEVAL_SQL}
SELECT query_id, relevant_found, total_relevant, retrieved_count, round(precision_at_k, 6) AS precision_at_k,
  round(recall_at_k, 6) AS recall_at_k, round(f1_at_k, 6) AS f1_at_k, round(mrr, 6) AS mrr,
  round(precision_docs, 6) AS precision_docs FROM retrieval""",
)
def eval_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    metrics = retrieval(spark, folder).drop("retrieved_docs")
    rates = ("precision_at_k", "recall_at_k", "f1_at_k", "mrr", "precision_docs")
    return metrics.withColumns({c: F.round(c, 6) for c in rates})


# Key points of an answer are the longer words of the turn before.
QUALITY_SQL = (
    PAIRS_SQL
    + f""",
points AS (SELECT *, list_filter({WORDS_SQL.format('question')}, lambda w: length(w) >= 5) AS key_points FROM turn_pairs),
quality AS (SELECT conv_id, turn, question, answer, key_points,
  CASE WHEN len(key_points) > 0 THEN len(list_filter(key_points, lambda w: contains(lower(answer), lower(w)))) / len(key_points) ELSE 0 END AS key_points_coverage,
  len(list_filter({_list(TERMS)}, lambda w: contains(lower(answer), w))) AS legal_terms_count,
  len(list_filter({_list(MARKERS)}, lambda w: contains(answer, w))) > 0 AS has_structured_response,
  len(regexp_extract_all(answer, '{CITED}')) AS citation_count,
  len({WORDS_SQL.format('answer')}) AS word_count,
  len(list_filter({_list(STYLE)}, lambda w: contains(lower(answer), w))) / {len(STYLE)} AS style_score
  FROM points)"""
)


def _long_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: F.char_length(w) >= 5)


def scored_answers(spark: SparkSession, folder: str) -> DataFrame:
    pairs = turn_pairs(spark, folder).withColumn("key_points", _long_words(F.col("question")))
    return ev.answer_quality(
        pairs, terms=TERMS, markers=MARKERS, style_words=STYLE, citation=CITED
    )


@query(
    "answer_quality",
    f"""WITH {QUALITY_SQL}
SELECT conv_id, turn, round(key_points_coverage, 6) AS key_points_coverage, legal_terms_count, has_structured_response,
  citation_count > 0 AS has_citations, citation_count, word_count, word_count BETWEEN 50 AND 500 AS is_adequate_length,
  round(style_score, 6) AS style_score FROM quality""",
)
def answer_quality(spark: SparkSession, folder: str) -> DataFrame:
    return scored_answers(spark, folder).select(
        "conv_id",
        "turn",
        F.round("key_points_coverage", 6).alias("key_points_coverage"),
        "legal_terms_count",
        "has_structured_response",
        "has_citations",
        "citation_count",
        "word_count",
        "is_adequate_length",
        F.round("style_score", 6).alias("style_score"),
    )


# Every answer is a case; conversation n is about question n mod number of questions.
CASES_SQL = (
    RETRIEVAL_SQL
    + ","
    + QUALITY_SQL
    + f""",
sides AS (SELECT conv_id || ':' || turn || ':p' AS k, array_to_string(key_points, ' ') AS text FROM quality
          UNION ALL SELECT conv_id || ':' || turn || ':a', answer FROM quality),
vectors AS ({hashed('sides', 'k')}),
norms AS (SELECT k, sqrt(sum(value * value)) AS norm FROM vectors GROUP BY k),
likeness AS (SELECT left(a.k, length(a.k) - 2) AS pair,
  sum(a.value * p.value) / any_value(na.norm * np.norm) AS semantic_similarity
  FROM vectors a JOIN vectors p ON p.k = left(a.k, length(a.k) - 2) || ':p' AND p.pos = a.pos
  JOIN norms na ON na.k = a.k JOIN norms np ON np.k = p.k WHERE a.k LIKE '%:a' GROUP BY 1),
cases AS (SELECT t.query_id, f.conv_id, f.turn, t.question, t.domain, t.difficulty, r.precision_at_k, r.recall_at_k, r.f1_at_k, r.mrr,
  r.docs, f.answer, f.key_points_coverage, f.citation_count > 0 AS has_citations, f.word_count,
  coalesce(s.semantic_similarity, 0) AS semantic_similarity
  FROM truth t JOIN retrieval r ON r.query_id = t.query_id
  JOIN quality f ON f.conv_id % (SELECT count(*) FROM benchmark) = t.query_id
  LEFT JOIN likeness s ON s.pair = f.conv_id || ':' || f.turn)"""
)


CASE = ("conv_id", "turn")

# One cases table per session and folder: all reports aggregate from it.
_written: dict[tuple[str, str], DataFrame] = {}


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of all answers, worked out once and written."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _written:
        _written[key] = cut_lineage(_cases(spark, folder))
    return _written[key]


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").count()
    answers = turn_pairs(spark, folder).select(
        F.pmod("conv_id", F.lit(asked)).alias("query_id"),
        *CASE,
        "answer",
        _long_words(F.col("question")).alias("key_points"),
    )
    quality = ev.answer_quality(
        answers, terms=TERMS, markers=MARKERS, style_words=STYLE, citation=CITED
    )
    similarity = (
        answers.withColumn("_points", F.array_join("key_points", " "))
        .select(*CASE, embed("answer").alias("a"), embed("_points").alias("p"))
        .select(*CASE, vx.cosine(F.col("a"), F.col("p")).alias("semantic_similarity"))
    )
    return ev.compile_cases(
        truth(spark, folder), retrieval(spark, folder), quality, similarity, CASE
    )


@query(
    "eval_cases",
    f"""WITH {CASES_SQL}
SELECT query_id, conv_id, turn, domain, difficulty, answer, array_to_string(docs, ' ') AS retrieved_docs, round(precision_at_k, 6) AS precision_at_k,
  round(mrr, 6) AS mrr, round(key_points_coverage, 6) AS key_points_coverage, word_count,
  round(semantic_similarity, 4) AS semantic_similarity FROM cases""",
)
def eval_cases(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).select(
        "query_id",
        *CASE,
        "domain",
        "difficulty",
        "answer",
        F.array_join("retrieved_docs", " ").alias("retrieved_docs"),
        F.round("precision_at_k", 6).alias("precision_at_k"),
        F.round("mrr", 6).alias("mrr"),
        F.round("key_points_coverage", 6).alias("key_points_coverage"),
        "word_count",
        F.round("semantic_similarity", 4).alias("semantic_similarity"),
    )


@query(
    "eval_overall",
    f"WITH {CASES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 4) AS mean, round(stddev_pop({m}), 4) AS std FROM cases"
        for m in ev.METRICS
    ),
)
def eval_overall(spark: SparkSession, folder: str) -> DataFrame:
    totals = ev.overall(cases(spark, folder))
    return totals.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "eval_grouped",
    f"""WITH {CASES_SQL}
SELECT CASE grouping_id(domain, difficulty) WHEN 1 THEN 'domain' WHEN 2 THEN 'difficulty' ELSE 'all' END AS "grouping",
  CASE grouping_id(domain, difficulty) WHEN 1 THEN domain WHEN 2 THEN difficulty ELSE 'all' END AS value,
  round(avg(precision_at_k), 4) AS mean_precision, round(avg(key_points_coverage), 4) AS mean_coverage, count(*) AS cases
FROM cases GROUP BY GROUPING SETS ((domain), (difficulty), ())""",
)
def eval_grouped(spark: SparkSession, folder: str) -> DataFrame:
    result = ev.grouped(cases(spark, folder))
    return result.withColumns({c: F.round(c, 4) for c in ("mean_precision", "mean_coverage")})


MEANS_SQL = """means AS (SELECT avg(precision_at_k) AS p, avg(key_points_coverage) AS c, avg(semantic_similarity) AS s FROM cases)"""


@query(
    "eval_grade",
    f"""WITH {CASES_SQL}, {MEANS_SQL},
score AS (SELECT *, (p * 0.3::DOUBLE + c * 0.4::DOUBLE + s * 0.3::DOUBLE) * 100 AS x FROM means)
SELECT round(x, 3) AS overall_score,
  CASE WHEN x >= 80 THEN 'EXCELLENT' WHEN x >= 70 THEN 'GOOD' WHEN x >= 60 THEN 'FAIR' ELSE 'POOR' END AS grade,
  round(p * 100, 3) AS precision_at_k_score, round(c * 100, 3) AS key_points_coverage_score,
  round(s * 100, 3) AS semantic_similarity_score FROM score""",
)
def eval_grade(spark: SparkSession, folder: str) -> DataFrame:
    result = ev.grade(cases(spark, folder))
    return result.withColumns({c: F.round(c, 3) for c in result.columns if c != "grade"})


@query(
    "eval_recommend",
    f"""WITH {CASES_SQL}, {MEANS_SQL},
parts AS (SELECT 'precision_at_k' AS component, p AS value FROM means UNION ALL
  SELECT 'key_points_coverage', c FROM means UNION ALL SELECT 'semantic_similarity', s FROM means),
advised(component, advice_no, advice) AS (VALUES """
    + ", ".join(f"('{c}', {i}, '{a}')" for c, advice in ev.ADVICE.items() for i, a in enumerate(advice))
    + """)
SELECT component, round(value, 4) AS value, advice_no, advice FROM parts JOIN advised USING (component) WHERE value < 0.7""",
)
def eval_recommend(spark: SparkSession, folder: str) -> DataFrame:
    return ev.recommendations(cases(spark, folder)).withColumn("value", F.round("value", 4))


@query(
    "eval_best_worst",
    f"""WITH {CASES_SQL},
picked AS (SELECT *, row_number() OVER (ORDER BY key_points_coverage DESC, conv_id, turn) AS b,
  row_number() OVER (ORDER BY key_points_coverage, conv_id, turn) AS w FROM cases)
SELECT 'best' AS kind, conv_id, turn, domain, difficulty, round(key_points_coverage, 6) AS key_points_coverage FROM picked WHERE b = 1
UNION ALL SELECT 'worst', conv_id, turn, domain, difficulty, round(key_points_coverage, 6) FROM picked WHERE w = 1""",
)
def eval_best_worst(spark: SparkSession, folder: str) -> DataFrame:
    result = ev.best_and_worst(cases(spark, folder), CASE)
    return result.withColumn("key_points_coverage", F.round("key_points_coverage", 6))


@query(
    "eval_summary",
    f"""WITH {CASES_SQL}
SELECT query_id, conv_id, turn, question[1:50] || '...' AS question, domain, difficulty, round(precision_at_k, 6) AS precision_at_5,
  round(key_points_coverage, 6) AS key_points_coverage, round(semantic_similarity, 4) AS semantic_similarity,
  has_citations, word_count FROM cases""",
)
def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ev.summary(cases(spark, folder), ("query_id", *CASE)).withColumns(
        {
            "precision_at_5": F.round("precision_at_5", 6),
            "key_points_coverage": F.round("key_points_coverage", 6),
            "semantic_similarity": F.round("semantic_similarity", 4),
        }
    )
