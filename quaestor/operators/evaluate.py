"""Scoring retrieval and answers against labelled cases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import bind, terms_in, word_count

# Terms, section headings, style words and the citation form that
# answers are scored by.
LEGAL_TERMS = (
    "btk", "bűnszervezet", "szabadságvesztés", "felperes", "alperes", "bíróság",
    "ítélet", "határozat", "törvény", "jog", "per", "vádlott",
)
SECTION_MARKERS = (
    "1. Szintetizált Válasz", "2. Részletes Elemzés", "3. Konklúzió", "4. Jogi nyilatkozat",
)
STYLE_WORDS = ("szerint", "alapján", "amely", "amelynek", "illetve", "továbbá")
CITATION = r"\(Forrás: [^)]+\)"

# Weights and bands of the grade, and the advice below a score.
GRADE_WEIGHTS = {"precision_at_k": 0.3, "key_points_coverage": 0.4, "semantic_similarity": 0.3}
GRADE_BANDS = ((80.0, "EXCELLENT"), (70.0, "GOOD"), (60.0, "FAIR"), (None, "POOR"))
ADVICE_BELOW = 0.7
ADVICE = {
    "precision_at_k": (
        "Consider improving embedding model or fine-tuning",
        "Experiment with different chunk sizes",
        "Add domain-specific preprocessing",
        "Implement hybrid search (dense + sparse)",
    ),
    "key_points_coverage": (
        "Improve prompt engineering",
        "Add more context to prompts",
        "Consider few-shot examples in prompts",
        "Fine-tune the LLM on legal domain",
    ),
    "semantic_similarity": (
        "Use domain-specific embeddings",
        "Add legal terminology preprocessing",
        "Implement reranking with legal-specific scoring",
    ),
}
METRICS = (
    "precision_at_k", "recall_at_k", "f1_at_k", "mrr", "key_points_coverage", "semantic_similarity",
)


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def evaluate_retrieval(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall, F1 and MRR per question, zero where undefined.

    `retrieved` has (query_id, doc_id, rank) with at most k rows per question,
    `truth` (query_id, doc_patterns) of regular expressions matched from the
    start of the id. `precision_at_k` counts matched patterns per retrieved
    document, `precision_docs` the matching documents.
    """
    listed = retrieved.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("_found")
    )
    ids = F.transform(F.coalesce("_found", F.array()), lambda r: r["doc_id"].cast("string"))

    def matches(doc: Column, pattern: Column) -> Column:
        return F.regexp_like(doc, F.concat(F.lit("^(?:"), pattern, F.lit(")")))

    cases = truth.join(listed, "query_id", "left").withColumn("retrieved_docs", ids)
    hits = F.transform(
        "retrieved_docs", lambda d: F.exists("doc_patterns", lambda p: matches(d, p))
    )
    patterns = F.filter("doc_patterns", lambda p: F.exists("retrieved_docs", lambda d: matches(d, p)))
    counted = cases.withColumn("_hits", hits).select(
        "query_id",
        "retrieved_docs",
        F.size(patterns).cast("long").alias("relevant_found"),
        F.size("doc_patterns").cast("long").alias("total_relevant"),
        F.size("retrieved_docs").cast("long").alias("retrieved_count"),
        F.size(F.filter("_hits", lambda h: h)).alias("_docs"),
        F.array_position("_hits", True).alias("_first"),
    )
    precision = share(F.col("relevant_found"), F.col("retrieved_count"))
    recall = share(F.col("relevant_found"), F.col("total_relevant"))
    return counted.select(
        "query_id",
        "retrieved_docs",
        precision.alias("precision_at_k"),
        recall.alias("recall_at_k"),
        share(2 * precision * recall, precision + recall).alias("f1_at_k"),
        share(F.lit(1.0), F.col("_first")).alias("mrr"),
        share(F.col("_docs"), F.col("retrieved_count")).alias("precision_docs"),
        "relevant_found",
        "total_relevant",
        "retrieved_count",
    )


def answer_quality(
    answers: DataFrame,
    answer: str = "answer",
    key_points: str = "key_points",
    terms: Sequence[str] = LEGAL_TERMS,
    markers: Sequence[str] = SECTION_MARKERS,
    style_words: Sequence[str] = STYLE_WORDS,
    citation: str = CITATION,
) -> DataFrame:
    """Add the answer's features: coverage, terms, structure, citations, length, style."""
    text = F.col(answer)
    points = bind(
        F.lower(text),
        lambda low: F.filter(key_points, lambda p: F.contains(low, F.lower(p))),
    )
    used = terms_in(text, terms)
    styled = terms_in(text, style_words)
    marked = [F.contains(text, F.lit(m)) for m in markers]
    citations = F.regexp_count(text, F.lit(citation)).cast("long")
    words = word_count(text)
    return answers.select(
        "*",
        share(F.size(points), F.size(key_points)).alias("key_points_coverage"),
        points.alias("key_points_found"),
        F.size(used).cast("long").alias("legal_terms_count"),
        used.alias("legal_terms_used"),
        reduce(or_, marked).alias("has_structured_response"),
        (citations > 0).alias("has_citations"),
        citations.alias("citation_count"),
        words.alias("word_count"),
        words.between(50, 500).alias("is_adequate_length"),
        (F.size(styled) / len(style_words)).alias("style_score"),
    )


def compile_cases(
    truth: DataFrame,
    retrieval: DataFrame,
    answers: DataFrame,
    similarity: DataFrame,
    case: Sequence[str] = ("query_id",),
) -> DataFrame:
    """One flat record per answer to a question that has retrieval metrics.

    A question may have many answers; `case` names the columns that tell them
    apart, which `answers` and `similarity` share.
    """
    known = [c for c in truth.columns if c in ("query_id", "question", "domain", "difficulty")]
    return (
        truth.select(*known)
        .join(retrieval, "query_id")
        .join(answers.drop(*[c for c in known if c != "query_id"]), "query_id")
        .join(similarity, list(case), "left")
        .withColumn("semantic_similarity", F.coalesce("semantic_similarity", F.lit(0.0)))
    )


def overall(cases: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric, a row per metric."""
    return (
        cases.select(*METRICS)
        .unpivot([], list(METRICS), "metric", "value")
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )


def grouped(cases: DataFrame) -> DataFrame:
    """Mean precision and coverage by domain, by difficulty and overall, in one pass."""
    domain, difficulty = F.col("domain"), F.col("difficulty")
    return (
        cases.groupingSets([[domain], [difficulty], []], domain, difficulty)
        .agg(
            F.grouping_id().alias("_level"),
            F.avg("precision_at_k").alias("mean_precision"),
            F.avg("key_points_coverage").alias("mean_coverage"),
            F.count("*").alias("cases"),
        )
        .select(
            F.when(F.col("_level") == 1, "domain")
            .when(F.col("_level") == 2, "difficulty")
            .otherwise("all")
            .alias("grouping"),
            F.when(F.col("_level") == 1, domain)
            .when(F.col("_level") == 2, difficulty)
            .otherwise("all")
            .alias("value"),
            "mean_precision",
            "mean_coverage",
            "cases",
        )
    )


def grade(cases: DataFrame) -> DataFrame:
    """The weighted score of 100, its band and the component scores."""
    means = cases.agg(*[F.avg(m).alias(m) for m in GRADE_WEIGHTS])
    score = sum((F.col(m) * w for m, w in GRADE_WEIGHTS.items()), F.lit(0.0)) * 100
    band = F.lit(GRADE_BANDS[-1][1])
    for limit, name in reversed(GRADE_BANDS[:-1]):
        band = F.when(score >= limit, name).otherwise(band)
    return means.select(
        score.alias("overall_score"),
        band.alias("grade"),
        *[(F.col(m) * 100).alias(f"{m}_score") for m in GRADE_WEIGHTS],
    )


def recommendations(cases: DataFrame) -> DataFrame:
    """Advice for each component whose mean is below the threshold."""
    spark = cases.sparkSession
    rules = spark.createDataFrame(
        [(c, i, a) for c, advice in ADVICE.items() for i, a in enumerate(advice)],
        "component string, advice_no int, advice string",
    )
    means = cases.agg(*[F.avg(m).alias(m) for m in ADVICE]).unpivot(
        [], list(ADVICE), "component", "value"
    )
    return means.filter(F.col("value") < ADVICE_BELOW).join(rules, "component")


def best_and_worst(cases: DataFrame, case: Sequence[str] = ("query_id",)) -> DataFrame:
    """The cases with the highest and the lowest coverage, the first on a tie."""
    row = F.struct(*case, "domain", "difficulty", "key_points_coverage")
    best = F.min_by(row, F.struct(-F.col("key_points_coverage"), *case))
    worst = F.min_by(row, F.struct("key_points_coverage", *case))
    both = F.array(
        F.struct(F.lit("best").alias("kind"), best.alias("row")),
        F.struct(F.lit("worst").alias("kind"), worst.alias("row")),
    )
    return cases.agg(both.alias("_both")).select(F.inline("_both")).select("kind", "row.*")


def summary(cases: DataFrame, case: Sequence[str] = ("query_id",)) -> DataFrame:
    """The report's columns, questions cut to 50 characters with a mark."""
    return cases.select(
        *case,
        F.concat(F.substring("question", 1, 50), F.lit("...")).alias("question"),
        "domain",
        "difficulty",
        F.col("precision_at_k").alias("precision_at_5"),
        "key_points_coverage",
        "semantic_similarity",
        "has_citations",
        "word_count",
    )
