"""Which requests of a log a cache with a time to live would have answered.

An entry is written at a miss and lives `ttl` from then; hits do not extend it.
The misses of a key form a chain: the first request, then each time the first
request at or after the last miss plus `ttl`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.scale import salted_join
from quaestor.session import cut_lineage

# Seconds an entry lives, by what it holds.
TTL_SECONDS = {"answer": 1800, "rerank": 600, "snippet": 1800, "embedding": 3600}

# Moments of one key that may be folded in a single task; the chains of busier
# keys are found with joins.
MAX_FOLD = 10_000


def ttl_cache_replay(
    requests: DataFrame,
    ttl: int,
    key: str = "key",
    at: str = "at",
    id_col: str = "request_id",
    max_fold: int = MAX_FOLD,
    carried: DataFrame | None = None,
) -> DataFrame:
    """`requests` with `cache_hit`; see `cache_misses` for the parameters."""
    misses = cache_misses(requests, ttl, key, at, id_col, max_fold, carried)
    known = misses.select(id_col, F.lit(True).alias("_miss"))
    return (
        requests.join(known, id_col, "left")
        .withColumn("cache_hit", F.col("_miss").isNull())
        .drop("_miss")
    )


def cache_misses(
    requests: DataFrame,
    ttl: int,
    key: str = "key",
    at: str = "at",
    id_col: str = "request_id",
    max_fold: int = MAX_FOLD,
    carried: DataFrame | None = None,
) -> DataFrame:
    """The misses (key, at, id). `at` is a whole number in the unit of `ttl`.

    `carried` has (key, expires) for entries written before the log began.
    Requests of one key at one moment collapse first, on the map side. Keys
    with few moments are folded in time order; the chains of the others are
    found by joins on (key, moment), in which no key is hot.
    """
    moments = requests.groupBy(key, at).agg(F.min(id_col).alias(id_col))
    if carried is not None:
        alive = salted_join(moments, carried.select(key, "expires"), [key], "left", [at])
        moments = alive.filter(F.col("expires").isNull() | (F.col(at) >= F.col("expires"))).drop(
            "expires"
        )
    sizes = moments.groupBy(key).agg(F.count("*").alias("_n"))
    busy = sizes.filter(F.col("_n") > max_fold).select(key)
    if busy.isEmpty():
        return _fold(moments, ttl, key, at, id_col)
    busy = cut_lineage(busy)
    quiet = moments.join(busy, key, "left_anti")
    crowded = moments.join(busy, key, "left_semi")
    return _fold(quiet, ttl, key, at, id_col).unionByName(_chains(crowded, ttl, key, at, id_col))


def _fold(moments: DataFrame, ttl: int, key: str, at: str, id_col: str) -> DataFrame:
    listed = moments.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(at, id_col))).alias("_moments")
    )
    item = moments.select(F.struct(at, id_col).alias("m")).schema["m"].dataType.simpleString()
    none = F.array().cast(f"array<{item}>")

    def step(misses, moment):
        last = F.try_element_at(misses, F.lit(-1))[at]
        alive = F.coalesce(moment[at] < last + ttl, F.lit(False))
        return F.when(alive, misses).otherwise(F.concat(misses, F.array(moment)))

    chain = F.aggregate("_moments", none, step)
    return listed.select(key, F.inline(chain)).select(key, at, id_col)


def _chains(moments: DataFrame, ttl: int, key: str, at: str, id_col: str) -> DataFrame:
    """Miss chains by doubling: links of 1, 2, 4, ... steps, then a walk back down.

    Links of twice the length start only where a link ends or a chain begins:
    no other moment is asked for later. So the levels shrink about as fast as
    the links grow.
    """
    starts = cut_lineage(moments.groupBy(key).agg(F.min(at).alias(at)))
    links = cut_lineage(_next_moments(moments, ttl, key, at))
    levels = []
    while not links.isEmpty():
        levels.append(links)
        ends = links.select(key, F.col("_next").alias(at)).unionByName(starts).distinct()
        onward = links.select(key, F.col(at).alias("_next"), F.col("_next").alias("_after"))
        links = cut_lineage(
            links.join(ends, [key, at], "left_semi")
            .join(onward, [key, "_next"])
            .select(key, at, F.col("_after").alias("_next"))
        )
    chain = starts
    for links in reversed(levels):
        both = F.explode(F.array_compact(F.array(at, "_next")))
        chain = chain.join(links, [key, at], "left").select(key, both.alias(at))
    return moments.join(chain, [key, at], "left_semi").select(key, at, id_col)


def _next_moments(moments: DataFrame, ttl: int, key: str, at: str, slices: int = 8) -> DataFrame:
    """(key, at, _next): the first moment at or after `at` + `ttl`, where there is one.

    Moments and the times asked for meet in slices of a fraction of the ttl; a
    time with no later moment in its slice takes the first of the next slice
    that has any.
    """
    width = max(1, ttl // slices)
    events = moments.select(
        key, F.col(at).alias("_time"), F.col(at).alias("_event"), F.lit(None).cast("long").alias("_asked")
    )
    asked = moments.select(
        key, (F.col(at) + ttl).alias("_time"), F.lit(None).cast("long").alias("_event"), F.col(at).alias("_asked")
    )
    both = events.unionByName(asked).withColumn("_slice", F.floor(F.col("_time") / width))
    # Backwards in time, events before the question asked at the same time.
    backwards = (
        Window.partitionBy(key, "_slice")
        .orderBy(F.col("_time").desc(), F.col("_asked").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = both.withColumn("_found", F.last("_event", ignorenulls=True).over(backwards)).filter(
        F.col("_asked").isNotNull()
    )
    later = (
        Window.partitionBy(key)
        .orderBy(F.col("_slice").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    firsts = both.groupBy(key, "_slice").agg(F.min("_event").alias("_first")).select(
        key, "_slice", F.last("_first", ignorenulls=True).over(later).alias("_later")
    )
    return (
        answered.join(firsts, [key, "_slice"])
        .select(key, F.col("_asked").alias(at), F.coalesce("_found", "_later").alias("_next"))
        .filter(F.col("_next").isNotNull())
    )
