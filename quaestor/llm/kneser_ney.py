"""Interpolated modified Kneser-Ney estimates from n-gram counts, as Spark jobs.

The counts of order n come from all training texts; those of the lower orders
are continuation counts, the number of different symbols seen before a gram.
Each order has three discounts from its counts of counts, and a context hands
what its grams are discounted to the next lower order; below the first order
stands the uniform distribution. All tables are sharded by gram or context and
meet in equi joins. Their size is bounded by the alphabet (see `symbols`).

An order without grams seen once to four times has the discounts 0.5, 1, 1.5.
Without any training text every gram has the uniform probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.stored import stored
from quaestor.llm.symbols import BASE, grams
from quaestor.llm.textops import blocks

#: Grams that a task collects before it adds them to its counts.
_COUNT_AT_ONCE = 8_000_000


def gram_counts(docs: DataFrame, order: int, text_col: str = "text") -> DataFrame:
    """(gram, n) over all texts; a task ships one row per distinct gram."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(BASE**order, np.int64), [], 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                waiting.append(grams(block, order)[0])
                size += len(waiting[-1])
                if size >= _COUNT_AT_ONCE:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total))
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(task, "gram bigint, n bigint")
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """`levels[k]`: (gram, p, context, weight) of order k + 1.

    `p` is the gram's interpolated probability; `weights[k]`: (context, weight)
    is the share that a context of k symbols leaves to the next lower order.
    """

    order: int
    levels: list[DataFrame]
    weights: list[DataFrame]


def fit(counts: DataFrame, order: int) -> Model:
    """The model of `counts` (gram, n) of the highest order."""
    tables = [stored(counts, "counts")]
    for k in range(order - 1, 0, -1):
        suffix = F.pmod("gram", F.lit(BASE**k)).alias("gram")
        tables.append(tables[-1].groupBy(suffix).agg(F.count("*").alias("n")))
    tables.reverse()
    of_counts = [
        t.filter(F.col("n") <= 4).groupBy(F.lit(k).alias("k"), "n").agg(F.count("*").alias("times"))
        for k, t in enumerate(tables)
    ]
    seen = {}
    for frame in [_union(of_counts)]:
        # At most four rows per order.
        seen = {(r.k, r.n): r.times for r in frame.collect()}
    levels, weights = [], []
    for k, table in enumerate(tables):
        discount = _discounts([seen.get((k, n), 0) for n in (1, 2, 3, 4)])
        context = F.floor(F.col("gram") / F.lit(BASE)).cast("long").alias("context")
        taken = _discount(F.col("n"), discount)
        by_context = table.select(context, "n", taken.alias("taken")).groupBy("context")
        totals = by_context.agg(F.sum("n").alias("total"), F.sum("taken").alias("taken"))
        totals = stored(totals.select("context", "total", (F.col("taken") / F.col("total")).alias("weight")), "weights")
        own = table.select("gram", context, ((F.col("n") - taken)).alias("own")).join(totals, "context")
        if k == 0:
            lower = F.lit(1.0 / BASE)
        else:
            below = levels[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            own = own.withColumn("suffix", F.pmod("gram", F.lit(BASE**k))).join(below, "suffix")
            lower = F.col("lower")
        p = F.col("own") / F.col("total") + F.col("weight") * lower
        levels.append(stored(own.select("gram", p.alias("p")), "level"))
        weights.append(totals.select("context", "weight"))
    return Model(order, levels, weights)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def _discounts(times: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many grams were seen once, twice, thrice, four times."""
    n1, n2, n3, n4 = times
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def probabilities(wanted: DataFrame, model: Model) -> DataFrame:
    """(gram, p) of every gram in `wanted`, seen in training or not.

    A chain of joins, one per order: a gram takes the estimate of the highest
    order that saw it, times the weights of the longer contexts on the way down.
    """
    found = wanted.select("gram").withColumn("p", F.lit(None).cast("double"))
    found = found.withColumn("_share", F.lit(1.0))
    for k in range(model.order - 1, -1, -1):
        level = model.levels[k].toDF("_gram", "_p")
        found = found.withColumn("_gram", F.pmod("gram", F.lit(BASE ** (k + 1)))).join(level, "_gram", "left")
        found = found.withColumn("p", F.coalesce("p", F.col("_share") * F.col("_p"))).drop("_p")
        context = F.floor(F.col("_gram") / F.lit(BASE)).cast("long")
        weight = model.weights[k].toDF("_context", "_weight")
        found = found.withColumn("_context", context).join(weight, "_context", "left")
        found = found.withColumn("_share", F.col("_share") * F.coalesce("_weight", F.lit(1.0)))
        found = found.select("gram", "p", "_share")
    return found.select("gram", F.coalesce("p", F.col("_share") / BASE).alias("p"))


class HashArrays:
    """The model as sorted arrays of gram codes with their logarithms beside them."""

    def __init__(self, model: Model):
        self.order = model.order
        self.levels = [_sorted(t.select("gram", F.log("p"))) for t in model.levels]
        self.weights = [_sorted(t.select("context", F.log("weight"))) for t in model.weights]

    def surprise(self, codes: np.ndarray) -> np.ndarray:
        """Minus the log probability of each n-gram; unseen ones back off."""
        value = np.zeros(len(codes), np.float64)
        todo = np.arange(len(codes))
        for k in range(self.order - 1, -1, -1):
            gram = codes[todo] % BASE ** (k + 1)
            hit, log_p = _look_up(self.levels[k], gram)
            value[todo[hit]] += log_p[hit]
            todo = todo[~hit]
            if not len(todo):
                return -value
            hit, log_w = _look_up(self.weights[k], gram[~hit] // BASE)
            value[todo[hit]] += log_w[hit]
        value[todo] -= math.log(BASE)
        return -value


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A table bounded by the alphabet, as arrays in the order of its keys."""
    rows = table.toArrow()
    keys, values = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.int32), values[order].astype(np.float32)


def _look_up(arrays: tuple[np.ndarray, np.ndarray], wanted: np.ndarray):
    keys, values = arrays
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
    place = np.minimum(np.searchsorted(keys, wanted.astype(np.int32)), len(keys) - 1)
    return keys[place] == wanted, values[place]
