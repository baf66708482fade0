"""A Bloom filter of fixed size, and joins that it keeps from moving texts.

The filter is 2 MB whatever it holds; past a few million keys it lets more and
more through, and the joins below, which are exact in any case, move more rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def bloom(hashes: DataFrame) -> np.ndarray:
    """The filter's words, from the 64-bit hashes in the first column.

    At most BITS / 64 rows reach the driver.
    """
    h = F.col(hashes.columns[0])
    probes = F.array(h.bitwiseAND(BITS - 1), F.shiftright(h, 32).bitwiseAND(BITS - 1))
    bit = hashes.select(F.explode(probes).alias("bit"))
    word = F.shiftright("bit", 6).cast("int").alias("word")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
    rows = bit.groupBy(word).agg(F.bit_or(mask).alias("mask")).toArrow()
    words = np.zeros(BITS // 64, np.uint64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for hashes that the filter certainly lacks."""
    hashes = hashes.view(np.uint64)
    found = np.ones(len(hashes), bool)
    for probe in (hashes & np.uint64(BITS - 1), (hashes >> np.uint64(32)) & np.uint64(BITS - 1)):
        found &= (words[probe >> np.uint64(6)] >> (probe & np.uint64(63))) & np.uint64(1) == 1
    return found


def _filtered(df: DataFrame, words: np.ndarray, key: Column, held: bool) -> DataFrame:
    """The rows whose key the filter may hold, or certainly lacks."""
    hashed = df.select(F.xxhash64(key).alias("_hash"), *[df[f"`{c}`"] for c in df.columns])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_hold(words, batch.column(0).to_numpy()) == held
            rows = pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:])
            yield rows.filter(pa.array(keep))

    return hashed.mapInArrow(task, df.schema)


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` is in the first column of `ids`; few others move."""
    wanted = ids.toDF(key)
    words = bloom(wanted.select(F.xxhash64(key)))
    return _filtered(df, words, df[key], True).join(wanted, key, "left_semi")


def anti_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` is not in the first column of `ids`; most don't move."""
    unwanted = ids.toDF(key)
    words = bloom(unwanted.select(F.xxhash64(key)))
    unsure = _filtered(df, words, df[key], True).join(unwanted, key, "left_anti")
    return _filtered(df, words, df[key], False).union(unsure.select(*df.columns))
