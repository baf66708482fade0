"""Building blocks that keep plans flat when keys are skewed or data is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import cut_lineage

# monotonically_increasing_id() keeps the row number in the low 33 bits.
_ROW_BITS = 33


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """First `k` rows of each group; `order` must be total.

    The bare `row_number() <= k` lets Spark insert WindowGroupLimit before the
    shuffle, so a map task ships at most `k` rows of a group.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= F.lit(k))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by `order`.

    An aggregate rather than a window: copies of a hot key collapse on the map
    side and never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    picked = df.groupBy(*keys).agg(pick)
    return picked.select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    )


def join_with_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a null key meets a null key."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    salts: int = 8,
) -> DataFrame:
    """Equi join in which one key of `left` may hold a large share of its rows.

    `right` should hold few rows per key, as it is repeated `salts` times; the
    rows of `left` are spread by a hash of `spread`, so reruns are identical.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    repeated = right.withColumn("_salt", F.explode(every))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def running_total(
    df: DataFrame,
    order: Sequence[str],
    weight: Column,
    total: str,
    group: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add the running sum of `weight` before each row, per group, by `order`.

    A range sort spreads even one huge group over many partitions. The sorted
    rows are written once, so partition numbers hold still; what remains is a
    sum per (partition, group) and its prefix sum, whose size depends on the
    number of partitions and not on the number of rows.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    sorted_rows = cut_lineage(
        ranged.sortWithinPartitions(*keys)
        .withColumn("_weight", weight.cast("long"))
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", _ROW_BITS))
    )
    slices = sorted_rows.groupBy("_part", *group).agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        "_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy("_part", *group)
        .orderBy("_seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = sorted_rows.withColumn(
        "_inner", F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    )
    return (
        join_with_nulls(counted, offsets, ["_part", *group])
        .withColumn(total, F.col("_offset") + F.col("_inner"))
        .drop("_part", "_seq", "_weight", "_inner", "_offset")
    )


def lag_in_slices(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Previous `value` of each series without putting a series in one task.

    The rows are range-sorted by series and `order` (which should be total), so
    a busy series lies in many slices. Inside a slice a window looks back; the
    first row of a series in a slice takes the last value of the slice before,
    from a table whose size depends on the slices and not on the rows.
    """
    keys = [*series, *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    sliced = cut_lineage(
        ranged.sortWithinPartitions(*keys)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", _ROW_BITS))
    )
    inside = Window.partitionBy("_part", *series).orderBy("_seq")
    last = sliced.groupBy("_part", *series).agg(F.max_by(value, "_seq").alias("_last"))
    carried = last.select(
        "_part", *series, F.lag("_last").over(Window.partitionBy(*series).orderBy("_part")).alias("_carry")
    )
    lagged = sliced.withColumn("_lag", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    return (
        join_with_nulls(lagged, carried, ["_part", *series])
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_seq", "_part", "_lag", "_first", "_carry")
    )
