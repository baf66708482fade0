"""Memo tables: compute a value per distinct key once and reuse it for a while."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.text import content_key
from quaestor.operators.cache_replay import TTL_SECONDS
from quaestor.session import cut_lineage


def memoize(
    rows: DataFrame,
    memo: DataFrame,
    prefix: str,
    text: str,
    compute: Callable[[Column], Column],
    now: Column,
    ttl_seconds: int = TTL_SECONDS["embedding"],
) -> tuple[DataFrame, DataFrame]:
    """(`rows` with `key`, `value` and `memo_hit`, new memo entries to append).

    `memo` holds (key, value, expires_at) and is live while expires_at is after
    `now`. Copies of one text collapse on the map side before the model sees
    them; the join back has one row per key on the right, so a text with a large
    part of the rows is split by the adaptive skew join. The new entries are
    written once, so the model runs once for both results.
    """
    keyed = rows.withColumn("key", content_key(prefix, F.col(text)))
    live = memo.filter(F.col("expires_at") > now).groupBy("key").agg(
        F.max_by("value", "expires_at").alias("value")
    )
    distinct = keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.any_value(text).alias("_text"))
    fresh = cut_lineage(
        distinct.join(live, "key", "left_anti").select(
            "key",
            compute(F.col("_text")).alias("value"),
            (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
        )
    )
    known = live.select("key", "value", F.lit(True).alias("memo_hit")).unionByName(
        fresh.select("key", "value", F.lit(False).alias("memo_hit"))
    )
    return keyed.join(known, "key", "left"), fresh
