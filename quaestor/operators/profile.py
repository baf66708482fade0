"""Profiling: nulls, numeric summaries, histograms, corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.scale import join_with_nulls, running_total


def profile_nulls(df: DataFrame) -> DataFrame:
    """(column, nulls, total, percent) of every column, in one pass."""
    counts = df.agg(
        F.count("*").alias("_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return counts.unpivot("_total", df.columns, "column", "nulls").select(
        "column",
        "nulls",
        F.col("_total").alias("total"),
        F.round(F.coalesce(F.try_divide("nulls", "_total"), F.lit(0.0)) * 100, 2).alias("percent"),
    )


def exact_percentiles(
    df: DataFrame,
    value: str,
    shares: Sequence[float],
    names: Sequence[str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per share.

    The distinct values are sorted over the cluster with their running counts
    and only the two neighbours of each percentile are picked, so neither many
    values nor a group with most of them meets in one task.
    """
    present = df.filter(F.col(value).isNotNull())
    counts = present.groupBy(*group, value).agg(F.count("*").alias("_n"))
    placed = running_total(counts, [value], F.col("_n"), "_before", group)
    totals = present.groupBy(*group).agg(F.count("*").alias("_total"))
    if group:
        placed = join_with_nulls(placed, totals, group)
    else:
        placed = placed.withColumn("_total", F.lit(totals.first()["_total"]))
    picks = []
    for share, name in zip(shares, names):
        at = (F.col("_total") - 1) * share
        for edge, position in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"{name}_{edge}"))
        picks.append(F.max(at - F.floor(at)).alias(f"{name}_part"))
    edges = placed.groupBy(*group).agg(*picks)
    return edges.select(
        *group,
        *[
            (
                F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")
            ).alias(n)
            for n in names
        ],
    )


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, a row per column."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    # One row with a struct per column: a scan that multiplies nothing.
    figures = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        )
        for c in columns
    ]
    basic = numbers.agg(F.array(*figures).alias("_all")).select(F.inline("_all"))
    long = numbers.unpivot([], list(columns), "column", "value")
    quartiles = exact_percentiles(
        long, "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], ["column"]
    )
    return basic.join(quartiles, "column", "left")


def year_histogram(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows per year from the first to the last, empty years included."""
    counts = df.filter(F.col(year).isNotNull()).groupBy(year).agg(F.count("*").alias("_n"))
    # From here on a row per year.
    following = F.lead(year).over(Window.orderBy(year))
    gaps = counts.withColumn("_end", F.coalesce(following - 1, F.col(year)))
    return gaps.select(
        F.explode(F.sequence(F.col(year), F.col("_end"))).alias("bin"), F.col(year).alias("_y"), "_n"
    ).select(
        F.col("bin").alias(year),
        F.when(F.col("bin") == F.col("_y"), F.col("_n")).otherwise(0).alias("n"),
    )


def corpus_stats(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    """Documents, chunks, chunks per document and text lengths; `approximate`
    counts documents with a sketch, which needs no shuffle of ids."""
    documents = F.approx_count_distinct("doc_id") if approximate else F.count_distinct("doc_id")
    length = F.char_length("text")
    return chunks.agg(
        documents.alias("documents"),
        F.count("*").alias("chunks"),
        F.avg(length).alias("avg_length"),
        F.min(length).cast("long").alias("min_length"),
        F.max(length).cast("long").alias("max_length"),
    ).withColumn("chunks_per_document", F.round(F.try_divide("chunks", "documents"), 1))
