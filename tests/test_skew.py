"""One key with a third of all rows: results stay whole and groups stay small."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import ingest as ig
from quaestor.operators import knn as nn
from quaestor.operators import service as sv
from quaestor.operators.cache_replay import ttl_cache_replay
from quaestor.operators.memo import memoize

ROWS = 60_000


def hot(spark, key="key"):
    name = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    return spark.range(0, ROWS, 1, 12).select("id", name.alias(key))


def test_duplicates_of_one_key_collapse(spark):
    rows = hot(spark, "chunk_id").withColumnRenamed("id", "doc_id")
    kept = ig.insert_ignore(rows, rows.limit(0).select("chunk_id"))
    names = rows.select("chunk_id").distinct().count()
    assert kept.count() == names
    assert kept.filter("chunk_id = 'hot'").first().doc_id == 0


def test_replay_of_a_busy_key(spark):
    log = hot(spark).select(F.col("id").alias("request_id"), "key", (F.col("id") * 7 % 100_003).alias("at"))
    quick = ttl_cache_replay(log, 250, max_fold=5_000)
    whole = ttl_cache_replay(log, 250, max_fold=ROWS)
    assert quick.count() == ROWS
    assert quick.select("request_id", "cache_hit").exceptAll(whole.select("request_id", "cache_hit")).isEmpty()
    assert quick.filter("key = 'hot' AND NOT cache_hit").count() > 300


def test_counter_of_a_busy_series(spark):
    log = hot(spark, "series").select(
        "series", "id", F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 1000).cast("double").alias("value")
    )
    grown = sv.counter_increase(log, ["series"], ["ts", "id"], "1 hour", "1 hour")
    total = grown.filter("series = 'hot'").agg(F.sum("increase")).first()[0]
    values = [i % 1000 for i in range(0, ROWS, 3)]
    assert total == sum(v if v < p else v - p for p, v in zip(values, values[1:]))


def test_sample_of_a_big_stratum(spark):
    sample = ig.stratified_sample(hot(spark, "lang"), "lang", "id", 0.25, digits=2)
    assert sample.filter("lang = 'hot'").count() == ROWS // 3 // 4


def test_neighbours_among_copies_and_in_one_big_cell(spark):
    rows = hot(spark).limit(6000).select(
        F.col("id").alias("chunk_id"),
        F.when(F.col("key") == "hot", F.array(F.lit(1.0), F.lit(0.0)))
        .otherwise(F.array((F.col("id") % 97) / 10.0 + 2, F.lit(1.0)))
        .cast("array<float>").alias("embedding"),
    )
    asked = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(3)], "query_id int, embedding array<float>")
    exact = nn.knn(asked, rows, 7)
    smallest = [r.chunk_id for r in rows.filter("embedding[0] = 1").orderBy("chunk_id").limit(7).collect()]
    for q in range(3):
        assert [r.chunk_id for r in exact.filter(F.col("query_id") == q).orderBy("rank").collect()] == smallest
    near = nn.grid_knn(
        asked.withColumn("cell", F.lit(0)), rows.withColumn("cell", F.lit(0)),
        7, "query_id", "chunk_id", "embedding", "l2", shard_rows=500,
    )
    sharded = nn.rank_neighbours(near, 7, "query_id", "chunk_id", "l2")
    assert sharded.select("query_id", "chunk_id", "rank").exceptAll(exact.select("query_id", "chunk_id", "rank")).isEmpty()


def test_memo_of_a_repeated_text(spark):
    rows = hot(spark, "text")
    memo = spark.createDataFrame([], "key string, value string, expires_at timestamp")
    now = F.expr("TIMESTAMP'2024-01-01'")
    found, fresh = memoize(rows, memo, "m", "text", F.upper, now)
    assert found.count() == ROWS and found.filter("value IS NULL").isEmpty()
    assert fresh.count() == rows.select("text").distinct().count()
