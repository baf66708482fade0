"""Cache labels for a stream of requests: repeated questions within the ttl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators.cache_replay import cache_misses
from quaestor.session import cut_lineage
from quaestor.streaming.sinks import BATCH, before_batch, drain, put_batch


def cache_stream(
    requests: DataFrame,
    target: str,
    entries: str,
    checkpoint: str,
    ttl: int,
    key: str = "key",
    at: str = "at",
    id_col: str = "request_id",
    lateness: int = 0,
    max_fold: int = 10_000,
) -> None:
    """Write the requests with `cache_hit` to `target`, batch by batch.

    The live entries (key, expires) are a table with one folder per batch; a
    batch starts from the entries of the one before. The batch operator does
    the work, so a key with most of a batch is spread as there. Entries that
    ended more than `lateness` before the batch's last request are let go.
    """

    def label(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = before_batch(spark, entries, batch_id)
        carried = None
        if stored is not None:
            carried = stored.filter(F.col(BATCH) == batch_id - 1).select(key, "expires")
        misses = cut_lineage(cache_misses(batch, ttl, key, at, id_col, max_fold, carried))
        known = misses.select(id_col, F.lit(True).alias("_miss"))
        labelled = batch.join(known, id_col, "left").withColumn("cache_hit", F.col("_miss").isNull())
        put_batch(labelled.drop("_miss"), target, batch_id)
        written = misses.select(key, (F.col(at) + ttl).alias("expires"))
        every = written if carried is None else written.unionByName(carried)
        live = every.groupBy(key).agg(F.max("expires").alias("expires"))
        last = batch.agg(F.max(at)).first()[0]
        if last is not None:
            live = live.filter(F.col("expires") > last - lateness)
        put_batch(live, entries, batch_id)

    drain(requests.writeStream.foreachBatch(label), checkpoint)
