"""A trained inverted-file index in a folder: built once, appended to, searched.

Centroids come from a bounded sample, the rows of smallest id hash; every row is
then assigned to its nearest centroid and written to its cell's folder. A cell
with more rows than `largest` gets centroids of its own from a bounded sample of
it, and rows are assigned anew, until no cell is overfull or what is left cannot
be told apart (equal vectors). Reads touch only the folders of probed cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import knn
from quaestor.operators.scale import top_per_group
from quaestor.session import cut_lineage

#: Rows that the centroids are trained on, and of one overfull cell.
SAMPLE_ROWS = 100_000
CELL_SAMPLE_ROWS = 4096
#: Cells that one overfull cell becomes at most in a round.
MOST_PARTS = 64
ROUNDS = 8


def train(
    corpus: DataFrame,
    lists: int,
    largest: int,
    id_col: str = "chunk_id",
    vector: str = "embedding",
    metric: str = "l2",
    sample_rows: int = SAMPLE_ROWS,
) -> np.ndarray:
    """Centroids, two or more, under which cells have at most `largest` rows, equal vectors aside."""
    dim = knn.dimension(corpus, vector)
    rows = knn.valid_vectors(corpus.select(id_col, vector), vector, dim)
    by_hash = [F.xxhash64(id_col), F.col(id_col)]
    sample = cut_lineage(rows.orderBy(*by_hash).limit(sample_rows), "sample")
    centroids = np.unique(knn.train_cells(sample, lists, vector, metric=metric, dim=dim), axis=0)
    whole: set[bytes] = set()
    for _ in range(ROUNDS):
        placed = knn.nearest_cells(rows, centroids, 1, vector, metric)
        # One row per overfull cell.
        counts = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > largest).collect()
        over = {r.cell: r.n for r in counts if centroids[r.cell].tobytes() not in whole}
        if not over:
            break
        taken = top_per_group(placed.filter(F.col("cell").isin(list(over))), ["cell"], by_hash, CELL_SAMPLE_ROWS)
        parts = {c: min(-(-2 * n // largest), MOST_PARTS) for c, n in over.items()}
        split = _split(taken.select("cell", vector), parts, vector)
        whole |= {centroids[c].tobytes() for c in over if len(split.get(c, ())) < 2}
        grown = {c: own for c, own in split.items() if len(own) > 1}
        kept = np.delete(centroids, list(grown), axis=0)
        centroids = np.unique(np.concatenate([kept, *grown.values()]), axis=0)
    return centroids


def _split(sample: DataFrame, parts: dict[int, int], vector: str) -> dict[int, np.ndarray]:
    """New centroids of each cell, from a few rounds of means over its sample."""

    def means(rows: pa.Table) -> pa.Table:
        points = knn._matrix(rows.column(vector))
        cell = rows.column("cell")[0].as_py()
        distinct = np.unique(points, axis=0)
        rng = np.random.default_rng(cell)
        centers = distinct[rng.choice(len(distinct), min(parts[cell], len(distinct)), replace=False)]
        for _ in range(10):
            far = (centers**2).sum(axis=1)[None, :] - 2 * points @ centers.T
            own = far.argmin(axis=1)
            n = np.bincount(own, minlength=len(centers))
            sums = np.zeros_like(centers)
            np.add.at(sums, own, points)
            centers = np.unique(sums[n > 0] / n[n > 0, None], axis=0)
        return pa.table({"cell": pa.array([cell] * len(centers), pa.int32()), "center": pa.array(centers.tolist())})

    found = sample.groupBy("cell").applyInArrow(means, "cell int, center array<double>").collect()
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(r.cell, []).append(r.center)
    return {c: np.array(centers) for c, centers in out.items()}


def build(
    corpus: DataFrame,
    path: str,
    lists: int,
    largest: int,
    id_col: str = "chunk_id",
    vector: str = "embedding",
    metric: str = "l2",
    sample_rows: int = SAMPLE_ROWS,
) -> None:
    """Train on `corpus` (id, vector) and write all its rows to the index at `path`."""
    spark = corpus.sparkSession
    centroids = train(corpus, lists, largest, id_col, vector, metric, sample_rows)
    cells = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(cells, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    append(corpus.select(id_col, vector), path, vector, metric)


def centroids_of(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r.centroid for r in rows])


def append(rows: DataFrame, path: str, vector: str = "embedding", metric: str = "l2") -> None:
    """Add rows to the cells they are nearest to; no other file is read or written."""
    placed = knn.nearest_cells(rows, centroids_of(rows.sparkSession, path), 1, vector, metric)
    placed.write.mode("append").partitionBy("cell").parquet(f"{path}/cells")


def search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int,
    probes: int,
    query_id: str = "query_id",
    id_col: str = "chunk_id",
    vector: str = "embedding",
    metric: str = "l2",
) -> DataFrame:
    """The `k` nearest rows among each question's `probes` nearest cells."""
    cells = spark.read.parquet(f"{path}/cells")
    return knn.ivf_knn(queries, cells, centroids_of(spark, path), k, probes, query_id, id_col, vector, metric)
