"""Nearest neighbours for whole batches of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.operators.scale import top_per_group
from quaestor.functions.vectors import l2_normalize
from quaestor.session import cut_lineage

# Questions that meet a task's rows as one matrix.
QUESTION_BLOCK = 1024
# Into how many groups the tasks' results are merged before the last merge.
MERGE_GROUPS = 64
# Rows of one shard of a cell in the sharded join.
SHARD_QUERIES = 1024
SHARD_ROWS = 16_384
# Vector elements of the candidate pairs compared at once (128 MB of doubles).
MAX_PAIR_ELEMENTS = 1 << 24


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, see `valid_vectors`, as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = set(column.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has `dim` values, none of them null."""
    whole = ~F.exists(vector, lambda x: x.isNull())
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) == dim) & whole)


def dimension(df: DataFrame, vector: str) -> int:
    """The most frequent vector length, the shorter on a tie; 0 without vectors."""
    sizes = df.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).count()
    row = sizes.agg(F.max_by("dim", F.struct("count", -F.col("dim"))).alias("dim")).first()
    return row["dim"] or 0


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(False)
    return values.astype(str) if values.dtype == object else values


def _nearest(
    questions: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, ...]:
    """The `k` nearest rows of each question as (question, row, distance, cosine).

    A matrix product picks candidates with a tolerance that keeps every tie;
    their distances are then taken row by row, so equal vectors get equal
    distances and ties fall to the smaller id.
    """
    q_norm = np.sqrt((questions**2).sum(axis=1))
    r_norm = np.sqrt((rows**2).sum(axis=1))
    product = rows @ questions.T
    if metric == "l2":
        rough = r_norm[:, None] ** 2 + q_norm[None, :] ** 2 - 2.0 * product
        slack = 1e-9 * (1.0 + q_norm**2 + (r_norm**2).max(initial=0.0))
    else:
        scale = r_norm[:, None] * q_norm[None, :]
        rough = -np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
        slack = np.full(len(questions), 1e-9)
    keep = min(k, len(rows))
    cut = np.partition(rough, keep - 1, axis=0)[keep - 1] + slack
    close = rough <= cut[None, :]
    # Copies of one vector all tie; take the questions in runs whose pairs fit.
    limit = max(1, MAX_PAIR_ELEMENTS // max(1, rows.shape[1]))
    run = np.cumsum(close.sum(axis=0)) // limit
    parts = []
    for first in np.flatnonzero(np.diff(run, prepend=-1)):
        members = np.flatnonzero(run == run[first])
        row_at, member = np.nonzero(close[:, members])
        question_at = members[member]
        picked, asked = rows[row_at], questions[question_at]
        distance = ((picked - asked) ** 2).sum(axis=1)
        scale = r_norm[row_at] * q_norm[question_at]
        inner = (picked * asked).sum(axis=1)
        similarity = np.divide(inner, scale, out=np.zeros_like(inner), where=scale > 0)
        parts.append(_best(question_at, ids[row_at], distance, similarity, k, metric))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _best(
    question_at: np.ndarray,
    ids: np.ndarray,
    distance: np.ndarray,
    similarity: np.ndarray,
    k: int,
    metric: str,
) -> tuple[np.ndarray, ...]:
    score = distance if metric == "l2" else -similarity
    order = np.lexsort((ids, score, question_at))
    question_at = question_at[order]
    starts = np.searchsorted(question_at, question_at, side="left")
    first_k = np.arange(len(order)) - starts < k
    chosen = order[first_k]
    return question_at[first_k], ids[chosen], distance[chosen], similarity[chosen]


def _result_schema(queries: DataFrame, corpus: DataFrame, query_id: str, id_col: str):
    return T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(id_col, corpus.schema[id_col].dataType),
            T.StructField("distance", T.DoubleType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    id_col: str = "chunk_id",
    vector: str = "embedding",
    metric: str = "l2",
    dim: int | None = None,
    block: int = QUESTION_BLOCK,
) -> DataFrame:
    """Exact `k` nearest corpus rows of every question, ties to the smaller id.

    Returns (query_id, id, distance, similarity, rank) with the squared L2
    distance and the cosine similarity. Vectors of other than `dim` values (by
    default the questions' most frequent length) or with null values take no
    part; `split_valid_vectors` names them.

    The questions are a stated set. They ride to the tasks in blocks of bounded
    size, and each block scans the corpus where it lies: the corpus never
    moves, and a task gives up only its best `k` per question.
    """
    dim = dimension(queries, vector) if dim is None else dim
    wanted = valid_vectors(queries.select(query_id, vector), vector, dim)
    rows = valid_vectors(corpus.select(id_col, vector), vector, dim)
    schema = _result_schema(wanted, rows, query_id, id_col)
    near = rows.sparkSession.createDataFrame([], schema)
    for batch in _blocks(wanted, block):
        near = near.union(_scan_knn(batch, rows, schema, k, metric))
    return rank_neighbours(near, k, query_id, id_col, metric)


def _blocks(wanted: DataFrame, size: int) -> Iterator[pa.Table]:
    """The questions in Arrow tables of at most `size` rows, one at a time."""
    whole = wanted.toArrow()
    for at in range(0, whole.num_rows, size):
        yield whole.slice(at, size)


def rank_neighbours(
    near: DataFrame, k: int, query_id: str, id_col: str, metric: str
) -> DataFrame:
    """The best `k` of each question, merged in two steps.

    First per group of tasks, so that however many tasks scanned the corpus no
    task of the last step sees more than `k * MERGE_GROUPS` rows of a question.
    """
    score = F.col("distance").asc() if metric == "l2" else F.col("similarity").desc()
    order = [score, F.col(id_col)]
    grouped = near.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    first = top_per_group(grouped, [query_id, "_group"], order, k, "_rank").drop("_group", "_rank")
    return top_per_group(first, [query_id], order, k)


def _scan_knn(
    batch: pa.Table, rows: DataFrame, schema: T.StructType, k: int, metric: str
) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((batch.column(0), _matrix(batch.column(1))))
    out = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, questions = shared.value
        best = None
        for chunk in batches:
            if chunk.num_rows == 0:
                continue
            found = _nearest(questions, _matrix(chunk.column(1)), _ids(chunk.column(0)), k, metric)
            if best is not None:
                found = tuple(np.concatenate(pair) for pair in zip(best, found))
            best = _best(*found, k, metric)
        if best is not None:
            at, ids, distance, similarity = best
            columns = [keys.take(pa.array(at)).combine_chunks(), ids, distance, similarity]
            arrays = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) for a, f in zip(arrays, out)], schema=out
            )

    return rows.mapInArrow(scan, schema)


def grid_knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str,
    id_col: str,
    vector: str,
    metric: str,
    shard_queries: int = SHARD_QUERIES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Best `k` rows per question inside each shared `cell`, not yet merged.

    Both sides of a cell are cut into shards of bounded size by a hash of the
    id and every pair of shards meets once, as matrices. A cell with most of
    the rows or most of the questions just has more shards, and a pair of
    shards gives up only `k` rows per question.
    """
    row_shards = F.ceil(F.count("*") / shard_rows).alias("row_shards")
    query_shards = F.ceil(F.count("*") / shard_queries).alias("query_shards")
    # One row per cell, counted once for both sides.
    sizes = cut_lineage(
        corpus.groupBy("cell").agg(row_shards).join(
            queries.groupBy("cell").agg(query_shards), "cell"
        )
    )
    zero, last = F.lit(0).cast("long"), F.lit(1)
    left = (
        queries.join(sizes, "cell")
        .withColumn("query_shard", F.pmod(F.xxhash64(query_id), F.col("query_shards")))
        .withColumn("row_shard", F.explode(F.sequence(zero, F.col("row_shards") - last)))
        .select("cell", "query_shard", "row_shard", query_id, vector)
    )
    right = (
        corpus.join(sizes, "cell")
        .withColumn("row_shard", F.pmod(F.xxhash64(id_col), F.col("row_shards")))
        .withColumn("query_shard", F.explode(F.sequence(zero, F.col("query_shards") - last)))
        .select("cell", "query_shard", "row_shard", id_col, vector)
    )
    schema = _result_schema(queries, corpus, query_id, id_col)
    out = _arrow_schema(schema)

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if asked.num_rows == 0 or rows.num_rows == 0:
            return out.empty_table()
        at, ids, distance, similarity = _nearest(
            _matrix(asked.column(vector)), _matrix(rows.column(vector)),
            _ids(rows.column(id_col)), k, metric,
        )
        keys = asked.column(query_id).combine_chunks().take(pa.array(at))
        arrays = [keys, pa.array(ids), pa.array(distance), pa.array(similarity)]
        return pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, out)], schema=out)

    shard = ["cell", "query_shard", "row_shard"]
    return left.groupBy(*shard).cogroup(right.groupBy(*shard)).applyInArrow(meet, schema)


def _unit(vector: str, metric: str) -> Column:
    """What cells are nearest by: the vector itself, or of length one for cosine."""
    plain = F.col(vector).cast("array<double>")
    return F.coalesce(l2_normalize(F.col(vector)), plain) if metric == "cosine" else plain


def train_cells(
    corpus: DataFrame,
    lists: int = 100,
    vector: str = "embedding",
    seed: int = 42,
    metric: str = "l2",
    dim: int | None = None,
) -> np.ndarray:
    """Centroids of an inverted-file index: a matrix of `lists` rows."""
    dim = dimension(corpus, vector) if dim is None else dim
    points = valid_vectors(corpus, vector, dim).select(
        array_to_vector(_unit(vector, metric)).alias("features")
    )
    model = KMeans(k=lists, seed=seed, maxIter=10, featuresCol="features").fit(points)
    return np.array(model.clusterCenters())


def nearest_cells(
    df: DataFrame,
    centroids: np.ndarray,
    probes: int,
    vector: str = "embedding",
    metric: str = "l2",
) -> DataFrame:
    """Add `cell`: one row per input row and each of its `probes` nearest cells.

    Rows whose vector has another length than the centroids are left out. For
    cosine, rows and centroids are compared at length one. Ties go to the first.
    """
    centroids = centroids.astype(np.float64)
    if metric == "cosine":
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        count = min(probes, len(cells))
        for chunk in batches:
            rows = _matrix(chunk.column(chunk.schema.get_field_index(vector)))
            if metric == "cosine":
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
            rough = (cells**2).sum(axis=1)[None, :] - 2.0 * (rows @ cells.T)
            near = np.argsort(rough, axis=1, kind="stable")[:, :count]
            repeated = chunk.take(pa.array(np.repeat(np.arange(len(rows)), count)))
            cell = pa.array(near.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*repeated.columns, cell], names=[*chunk.schema.names, "cell"]
            )

    return valid_vectors(df, vector, centroids.shape[1]).mapInArrow(assign, schema)


def ivf_knn(
    queries: DataFrame,
    cells: DataFrame,
    centroids: np.ndarray,
    k: int,
    probes: int = 10,
    query_id: str = "query_id",
    id_col: str = "chunk_id",
    vector: str = "embedding",
    metric: str = "l2",
) -> DataFrame:
    """Approximate `k` nearest rows: only the `probes` nearest cells are read.

    `cells` is the corpus with its `cell` column, best written with
    `write_ivf`, which keeps a folder per cell. With `probes` equal to
    the number of cells the result is exact.
    """
    asked = cut_lineage(
        nearest_cells(queries.select(query_id, vector), centroids, probes, vector, metric)
    )
    # At most one number per centroid; as a literal filter it prunes folders.
    probed = [row["cell"] for row in asked.select("cell").distinct().collect()]
    rows = cells.select("cell", id_col, vector).filter(F.col("cell").isin(probed))
    near = grid_knn(asked, rows, k, query_id, id_col, vector, metric)
    return rank_neighbours(near, k, query_id, id_col, metric)


def write_ivf(
    corpus: DataFrame,
    centroids: np.ndarray,
    path: str,
    vector: str = "embedding",
    metric: str = "l2",
):
    """Write the corpus as one folder per cell."""
    cells = nearest_cells(corpus, centroids, 1, vector, metric)
    cells.write.mode("overwrite").partitionBy("cell").parquet(path)


def recall_at_k(
    found: DataFrame, exact: DataFrame, query_id: str = "query_id", id_col: str = "chunk_id"
) -> DataFrame:
    """Share of the exact neighbours that `found` holds, per question."""
    hits = found.select(query_id, id_col, F.lit(1).alias("hit"))
    return (
        exact.join(hits, [query_id, id_col], "left")
        .groupBy(query_id)
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )
