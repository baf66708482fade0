"""Every stream gives what its batch twin gives, also over a restart."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.functions.embedding import HashEmbedder, embed_udf
from quaestor.operators import service as sv
from quaestor.operators.cache_replay import ttl_cache_replay
from quaestor.operators.ingest import insert_ignore
from quaestor.operators.knn import knn
from quaestor.operators.retrieval import score_hybrid
from quaestor.plans.common import epoch_seconds
from quaestor.streaming.alerts import alert_stream
from quaestor.streaming.ingest import ingest_stream
from quaestor.streaming.memo import cache_stream
from quaestor.streaming.metrics import stream_rates
from quaestor.streaming.questions import question_stream
from quaestor.streaming.sinks import file_stream
from tests.oracle import folder


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def events(spark):
    return spark.read.parquet(f"{folder()}/events.parquet")


def feed(df, path, order, files=3):
    """Write `df` as several files, in order of time."""
    bounds = df.approxQuantile(order, [i / files for i in range(1, files)], 0.0)
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.filter(F.col(order) >= low)
        part = part if high is None else part.filter(F.col(order) < high)
        part.coalesce(1).write.mode("append").parquet(path)


def test_ingest_stream_matches_batch_and_restarts(spark, tmp_path):
    docs = spark.read.parquet(f"{folder()}/documents.parquet").select(
        F.sha2("text", 256).alias("chunk_id"), "doc_id", "source"
    )
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    feed(docs, source, "doc_id")
    for _ in range(2):
        ingest_stream(file_stream(spark, source, docs.schema, 1), target, checkpoint)
        stored = spark.read.parquet(target)
        want = insert_ignore(docs, docs.limit(0))
        assert rows(stored, "chunk_id", "doc_id") == rows(want, "chunk_id", "doc_id")
    late = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000)
    fresh = spark.createDataFrame([("new", 7, "s")], docs.schema)
    late.unionByName(fresh).coalesce(1).write.mode("append").parquet(source)
    ingest_stream(file_stream(spark, source, docs.schema, 1), target, checkpoint)
    assert spark.read.parquet(target).count() == want.count() + 1
    # A stream with a checkpoint of its own adds to the table.
    more = str(tmp_path / "more")
    spark.createDataFrame([("newer", 8, "s"), ("new", 9, "s")], docs.schema).write.parquet(more)
    ingest_stream(file_stream(spark, more, docs.schema, 1), target, str(tmp_path / "check2"))
    assert spark.read.parquet(target).count() == want.count() + 2


def test_stream_rates_match_batch_on_closed_windows(spark, tmp_path):
    requests = events(spark).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 30).alias("latency_s"),
    )
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    feed(requests.withColumn("n", F.unix_micros("ts").cast("double")), source, "n")
    stream = file_stream(spark, source, "ts timestamp, status int, latency_s double", 1)
    rates = stream_rates(stream, "1 hour", "1 hour", "30 minutes")
    writer = rates.writeStream.format("parquet").option("path", target).outputMode("append")
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(target)
    closed = requests.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    want = sv.window_rates(requests, "1 hour", "30 minutes").filter(F.col("window_end") <= closed)
    columns = ["window_start", "requests", "errors", F.round("qps", 9), F.round("mean_latency_s", 6)]
    assert rows(got, *columns) == rows(want, *columns)
    assert got.count() > 1000


def test_alert_stream_matches_batch(spark, tmp_path):
    latency = events(spark).select(
        "ts", F.col("event_type").alias("series"), (F.col("value") / 30).alias("latency_s")
    )
    windows = sv.stage_latency(latency, "1 hour", "30 minutes", "series").select(
        "series", epoch_seconds(F.col("window_start")).alias("at"), F.col("mean_latency_s").alias("value"),
        "window_start",
    )
    want = sv.alert_for(windows, F.col("value") > 1.5, 3600, 1800, ["series"])
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    feed(windows.drop("window_start").withColumn("n", F.col("at").cast("double")), source, "n")
    stream = file_stream(spark, source, "series string, at long, value double", 1)
    states = alert_stream(stream, 1.5, 3600, 1800)
    writer = states.writeStream.format("parquet").option("path", target).outputMode("append")
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(target)
    assert got.filter("state = 'firing'").count() > 10
    since = epoch_seconds(F.col("active_since")).alias("active_since")
    assert rows(got, "series", "at", "state", F.coalesce("active_since", F.lit(-1))) == rows(
        want.select("series", "at", "state", since), "series", "at", "state",
        F.coalesce("active_since", F.lit(-1)),
    )


def test_alert_stream_leaves_late_rows_out(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "series string, at long, value double"
    batches = [[(0, 9.0), (60, 9.0)], [(30, 0.0), (120, 9.0), (180, 0.0)], [(240, 9.0)]]
    for rows_in in batches:
        part = spark.createDataFrame([("s", *r) for r in rows_in], schema)
        part.coalesce(1).write.mode("append").parquet(source)
        states = alert_stream(file_stream(spark, source, schema, 1), 1.0, 120, 60)
        writer = states.writeStream.format("parquet").option("path", target).outputMode("append")
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(target), "at", "state", F.coalesce("active_since", F.lit(-1)))
    assert got == [(0, "pending", 0), (60, "pending", 0), (120, "firing", 0), (180, "inactive", -1), (240, "pending", 240)]


def test_alert_stream_resolves_silent_series(spark, tmp_path):
    """One series goes on, one pauses and returns, one falls silent for good."""
    moments = {
        "steady": range(0, 3000, 60),
        "paused": [*range(0, 600, 60), *range(1500, 3000, 60)],
        "short": [*range(0, 600, 60), *range(720, 3000, 60)],
        "gone": range(0, 900, 60),
        "calm": range(0, 300, 60),
    }
    schema = "series string, at long, value double"
    begin = 600_000
    every = [(s, begin + at, 0.0 if s == "calm" else 9.0) for s, times in moments.items() for at in times]
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for low in range(begin, begin + 3000, 600):
        part = [r for r in every if low <= r[1] < low + 600]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        states = alert_stream(file_stream(spark, source, schema, 1), 1.0, 300, 60, late=60)
        writer = states.writeStream.format("parquet").option("path", target).outputMode("append")
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    table = spark.createDataFrame(every, schema).withColumn("window_start", F.timestamp_seconds("at"))
    filled = sv.with_silences(table, "value", 60, ["series"])
    want = sv.alert_for(filled, F.col("value") > 1.0, 300, 60, ["series"])
    got = spark.read.parquet(target)
    plain = lambda c: F.coalesce(c, F.lit(-1))
    assert rows(got, "series", "at", "state", plain(F.col("active_since"))) == rows(
        want, "series", epoch_seconds(F.col("window_start")), "state", plain(epoch_seconds(F.col("active_since")))
    )
    ended = {r.series: (r.at, r.state) for r in got.orderBy("at").collect()}
    assert ended["gone"] == (begin + 900, "inactive") and ended["calm"] == (begin + 300, "inactive")
    assert ended["steady"] == (begin + 2940, "firing")
    resolved = {(r.series, r.at - begin) for r in got.filter("state = 'inactive' and series != 'calm'").collect()}
    assert resolved == {("paused", 600), ("short", 600), ("gone", 900)}


def test_silences_of_empty_and_odd_rows(spark):
    schema = "series string, window_start timestamp_ntz, value double"
    assert sv.with_silences(spark.createDataFrame([], schema), "value", 60, ["series"]).collect() == []
    table = spark.sql("""SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 00:00:00', 1.0D),
        ('a', TIMESTAMP_NTZ '2024-01-01 00:00:00', 1.0D), (NULL, TIMESTAMP_NTZ '2024-01-01 00:02:00', NULL),
        ('a', NULL, 3.0D) AS t(series, window_start, value)""")
    got = sv.with_silences(table, "value", 60, ["series"])
    assert got.schema["window_start"].dataType.simpleString() == "timestamp_ntz"
    assert sorted((str(r.series), r.window_start.minute, r.value is None) for r in got.collect()) == [
        ("None", 2, True), ("a", 0, False), ("a", 0, False), ("a", 1, True),
    ]


def test_cache_stream_matches_batch(spark, tmp_path):
    log = events(spark).select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("key"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
    )
    source, target, entries, checkpoint = (str(tmp_path / n) for n in ("in", "out", "live", "check"))
    feed(log, source, "at")
    stream = file_stream(spark, source, log.schema, 1)
    cache_stream(stream, target, entries, checkpoint, 1800)
    want = ttl_cache_replay(log, 1800)
    assert rows(spark.read.parquet(target), "request_id", "cache_hit") == rows(
        want, "request_id", "cache_hit"
    )


def test_question_stream_matches_batch(spark, tmp_path):
    embed = embed_udf(lambda: HashEmbedder(32))
    corpus = spark.read.parquet(f"{folder()}/documents.parquet").select(
        F.col("doc_id").alias("chunk_id"), "text", embed("text").alias("embedding")
    )
    asked = spark.read.parquet(f"{folder()}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    feed(asked, source, "query_id", files=2)
    question_stream(file_stream(spark, source, asked.schema, 1), corpus, target, checkpoint, embed)
    near = knn(asked.withColumn("embedding", embed("question")), corpus, 20)
    want = score_hybrid(near.join(corpus.select("chunk_id", "text"), "chunk_id"))
    columns = ("query_id", "chunk_id", "final_score", "rank")
    assert rows(spark.read.parquet(target), *columns) == rows(want, *columns)
