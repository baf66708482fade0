from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from quaestor.operators import knn as nn
from quaestor.operators import vector_index


def vectors(seed, n, first=0):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(0).normal(size=(12, 16)) * 4
    at = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 12, n))  # a hot topic
    points = centers[at] + rng.normal(size=(n, 16))
    return [(first + i, p.tolist()) for i, p in enumerate(points)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = vectors(1, 3000)
    odd = [(9000, None), (9001, [1.0, 2.0]), (9002, [None] * 16)]
    df = spark.createDataFrame([*rows, *odd], "chunk_id long, embedding array<float>").repartition(5)
    vector_index.build(df, path, lists=8, largest=300, sample_rows=500)
    return path, rows


def test_overfull_cells_are_split(spark, index):
    path, rows = index
    held = Counter(r.cell for r in spark.read.parquet(f"{path}/cells").select("cell").collect())
    assert sum(held.values()) == len(rows) and max(held.values()) <= 300
    assert len(held) <= len(vector_index.centroids_of(spark, path))


def test_equal_vectors_end_the_splitting(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(1000)], "chunk_id long, embedding array<float>")
    vector_index.build(df, str(tmp_path), lists=2, largest=10)
    held = Counter(r.cell for r in spark.read.parquet(f"{tmp_path}/cells").select("cell").collect())
    assert sorted(held.values()) == [500, 500]


def test_recall_of_every_twentieth_row(spark, index):
    path, rows = index
    asked = spark.createDataFrame(rows[::20], "query_id long, embedding array<float>")
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    exact = nn.knn(asked, df, 10)
    cells = len(vector_index.centroids_of(spark, path))
    some = vector_index.search(spark, path, asked, 10, probes=cells // 2)
    recall = [r.recall for r in nn.recall_at_k(some, exact).collect()]
    assert len(recall) == len(rows[::20]) and np.mean(recall) >= 0.9
    every = vector_index.search(spark, path, asked, 10, probes=cells)
    key = lambda r: (r.query_id, r["rank"], r.chunk_id)
    assert sorted(map(key, every.collect())) == sorted(map(key, exact.collect()))


def test_appended_rows_are_found_and_few_folders_read(spark, index, tmp_path):
    _, rows = index
    path = str(tmp_path)
    frame = lambda r, name="chunk_id": spark.createDataFrame(r, f"{name} long, embedding array<float>")
    vector_index.build(frame(rows), path, lists=8, largest=300)
    more = vectors(2, 200, first=5000)
    vector_index.append(frame(more), path)
    found = vector_index.search(spark, path, frame(more[:5], "query_id"), 1, probes=1)
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(i, i) for i, _ in more[:5]}
    cell = spark.read.parquet(f"{path}/cells").first().cell
    plan = spark.read.parquet(f"{path}/cells").filter(f"cell IN ({cell}, -1)")._jdf.queryExecution().executedPlan()
    assert re.search(r"PartitionFilters: \[[^]]*cell", plan.toString())
