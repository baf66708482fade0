"""Neighbour search against brute force, with ties, odd vectors and big batches."""

from __future__ import annotations

import numpy as np
import pytest

from quaestor.operators import knn as nn


def brute(questions, rows, k, metric="l2"):
    result = []
    for qid, q in questions:
        scored = []
        for rid, r in rows:
            q64, r64 = np.float64(np.float32(q)), np.float64(np.float32(r))
            if metric == "l2":
                score = ((q64 - r64) ** 2).sum()
            else:
                norm = np.sqrt((q64**2).sum()) * np.sqrt((r64**2).sum())
                score = -((q64 * r64).sum() / norm if norm > 0 else 0.0)
            scored.append((round(float(score), 9), rid))
        result += [(qid, rid, n + 1) for n, (_, rid) in enumerate(sorted(scored)[:k])]
    return sorted(result)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    base = rng.integers(-2, 3, size=(40, 6)).astype(float)
    rows = [(f"r{i:03d}", base[i % 40].tolist()) for i in range(120)]  # each vector three times
    rows.append(("zero", [0.0] * 6))
    questions = [(i, rng.integers(-2, 3, size=6).astype(float).tolist()) for i in range(25)]
    return questions, rows


def frames(spark, questions, rows):
    return (
        spark.createDataFrame(questions, "query_id int, embedding array<float>"),
        spark.createDataFrame([*rows, ("null", None)], "chunk_id string, embedding array<float>").repartition(7),
    )


def found(df):
    return sorted((r.query_id, r.chunk_id, r.rank) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("limit", [1000, 3])
def test_exact_search_breaks_ties_by_id(spark, data, metric, limit):
    q, c = frames(spark, *data)
    got = nn.knn(q, c, 5, metric=metric, block=limit)
    assert found(got) == brute(*data, 5, metric)


def test_small_shards_and_pairs_give_the_same(spark, data, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(nn, "MAX_PAIR_ELEMENTS", 12)
    q, c = frames(spark, *data)
    cell = F.lit(0)
    near = nn.grid_knn(
        q.withColumn("cell", cell), c.filter("embedding is not null").withColumn("cell", cell),
        4, "query_id", "chunk_id", "embedding", "l2", shard_queries=4, shard_rows=9,
    )
    assert found(nn.rank_neighbours(near, 4, "query_id", "chunk_id", "l2")) == brute(*data, 4)


def test_vectors_of_other_lengths_take_no_part(spark, data):
    questions, rows = data
    q, c = frames(spark, questions, rows)
    odd = [("short", [0.0] * 4), ("long", [0.0] * 12), ("hole", [0.0] * 5 + [None]), ("none", [])]
    flawed = c.union(spark.createDataFrame(odd, c.schema))
    asked = q.union(spark.createDataFrame([(99, [1.0]), (98, [1.0, None, 1.0, 1.0, 1.0, 1.0])], q.schema))
    assert found(nn.knn(asked, flawed, 5)) == brute(questions, rows, 5)
    centroids = nn.train_cells(flawed, lists=4)
    assert centroids.shape == (4, 6)
    assert nn.nearest_cells(flawed, centroids, 1).count() == len(rows)


def test_many_questions_never_move_the_corpus(spark, data):
    _, rows = data
    rng = np.random.default_rng(3)
    questions = [(i, rng.normal(size=6).tolist()) for i in range(5000)]
    q, c = frames(spark, questions, rows)
    got = nn.knn(q, c, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in "".join(x for x in plan.split("\n") if "Exchange" in x and "RoundRobin" not in x)
    some = got.filter("query_id < 40")
    assert found(some) == brute(questions[:40], rows, 3)
    assert got.count() == 15_000


def test_k_beyond_the_corpus_and_empty_batch(spark, data):
    questions, rows = data
    q, c = frames(spark, questions[:2], rows[:3])
    assert found(nn.knn(q, c, 10)) == brute(questions[:2], rows[:3], 10)
    assert nn.knn(q.limit(0), c, 10).count() == 0
    assert nn.knn(q, c.limit(0), 10).count() == 0


def test_ivf_with_all_cells_is_exact_and_with_few_is_close(spark, data, tmp_path):
    q, c = frames(spark, *data)
    centroids = nn.train_cells(c, lists=8)
    nn.write_ivf(c, centroids, str(tmp_path / "ivf"))
    cells = spark.read.parquet(str(tmp_path / "ivf"))
    exact = nn.knn(q, c, 5)
    every = nn.ivf_knn(q, cells, centroids, 5, probes=len(centroids))
    assert found(every) == found(exact)
    some = nn.ivf_knn(q, cells, centroids, 5, probes=4)
    recall = nn.recall_at_k(some, exact).agg({"recall": "avg"}).first()[0]
    assert recall >= 0.8
    for metric in ("l2", "cosine"):
        centroids = nn.train_cells(c, lists=8, metric=metric)
        cells = nn.nearest_cells(c, centroids, 1, metric=metric)
        every = nn.ivf_knn(q, cells, centroids, 5, probes=8, metric=metric)
        assert found(every) == found(nn.knn(q, c, 5, metric=metric))
