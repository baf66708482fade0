"""The plans stay the ones we want: no cross joins, pruned scans, early limits."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from quaestor.operators.knn import knn
from quaestor.plans.common import chunk_vectors, questions
from tests.oracle import folder

QUERIES = entry.queries()


def plan(spark, key):
    return QUERIES[key](spark, folder())._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "key", ["hybrid_merge", "text_search", "snippet_topk", "eval_grade", "ttl_cache_replay", "embed_memo"]
)
def test_no_cross_joins(spark, key):
    text = plan(spark, key)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("key", ["knn_l2", "text_search", "keyword_search", "batch_done", "hybrid_merge"])
def test_top_k_is_cut_before_the_shuffle(spark, key):
    text = plan(spark, key)
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_index_cells_prune_folders(spark):
    for key in ("ivf_knn", "ivf_knn_cosine"):
        assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan(spark, key))


def test_text_search_moves_no_postings(spark):
    for key in ("text_search", "text_search_all"):
        exchanges = [x for x in plan(spark, key).split("\n") if "Exchange" in x]
        assert len(exchanges) == 1 and "query_id" in exchanges[0]


def test_progress_and_positions_stay_spread(spark):
    text = plan(spark, "ingest_progress")
    assert "SinglePartition" not in text and "Window" not in text
    assert "embedding" not in plan(spark, "vec_index")


def test_every_answer_is_a_case(spark):
    turns = spark.read.parquet(f"{folder()}/conversations.parquet")
    answers = turns.filter("role = 'assistant'").count()
    for key in ("eval_cases", "eval_summary"):
        assert QUERIES[key](spark, folder()).count() == answers


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(spark, "sql_param")
    assert "ReadSchema: struct<lang:string,n_chars:bigint>" in text
    assert "GreaterThanOrEqual(n_chars,500)" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(spark, "fk_orphans")
    assert "text" not in re.search(r"ReadSchema: \S+", plan(spark, "scan_checked")).group()


@pytest.mark.parametrize(
    "key", ["chunk_fixed", "answer_quality", "request_counts", "latency_histogram", "rerank_merge", "text_index"]
)
def test_python_only_where_needed(spark, key):
    text = plan(spark, key)
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("key", ["qps_windows", "canary_assign", "word_counts", "request_valid"])
def test_at_most_one_shuffle(spark, key):
    assert plan(spark, key).count("Exchange") <= 1


def test_large_question_batches_meet_without_a_cross_join(spark):
    near = knn(questions(spark, folder()), chunk_vectors(spark, folder()), 5, block=3)
    text = near._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
