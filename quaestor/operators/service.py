"""Service analytics over a request log: rates, latencies, objectives, alerts.

A request row has ts, endpoint, method, status, latency_s, cache_hit and
cost_usd; `ts` may be with or without zone.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.operators.profile import exact_percentiles
from quaestor.operators.scale import lag_in_slices

# The default latency buckets of the metrics client, in seconds.
BUCKETS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"),
)

# Dashboard colour steps, (green below, yellow below, then red)
# or, for figures that should be high, (red below, yellow below, then green).
PANELS = {
    "p95_latency_s": (1.0, 2.0, ("green", "yellow", "red")),
    "error_rate_pct": (0.5, 1.0, ("green", "yellow", "red")),
    "cache_hit_pct": (30.0, 50.0, ("red", "yellow", "green")),
    "qps": (10.0, 50.0, ("red", "yellow", "green")),
    "cost_per_query_usd": (0.01, 0.05, ("green", "yellow", "red")),
}

# Service level objectives, (comparison, bound).
OBJECTIVES = {
    "p95_latency_s": ("<", 2.0),
    "p99_latency_s": ("<", 5.0),
    "error_rate_pct": ("<", 1.0),
    "retrieval_p95_s": ("<", 1.0),
    "generation_p95_s": ("<", 3.0),
    "cache_hit_pct": (">", 80.0),
}



def is_error(status: Column) -> Column:
    return status.between(500, 599)


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests by method, endpoint and status; one that failed without a status is a 500."""
    return (
        requests.withColumn("status", F.coalesce("status", F.lit(500)))
        .groupBy("method", "endpoint", "status")
        .agg(F.count("*").alias("requests"))
    )


def latency_histogram(
    requests: DataFrame, buckets: Sequence[float] = BUCKETS, by: Sequence[str] = ("endpoint",)
) -> DataFrame:
    """Cumulative bucket counts per group, with the sum and count of latencies.

    All buckets are counted in one pass and unpivoted afterwards.
    """
    latency = F.col("latency_s")
    counted = requests.filter(latency.isNotNull()).groupBy(*by).agg(
        F.array(
            *[
                F.struct(F.lit(le).alias("le"), F.count_if(latency <= le).alias("cumulative"))
                for le in buckets
            ]
        ).alias("_buckets"),
        F.sum(latency).alias("total_s"),
        F.count("*").alias("observations"),
    )
    return counted.select(*by, F.inline("_buckets"), "total_s", "observations")


def histogram_quantile(
    histogram: DataFrame, q: float, by: Sequence[str] = ("endpoint",)
) -> DataFrame:
    """Quantile estimated from cumulative buckets by linear interpolation.

    The first bucket starts at 0; a quantile in the last, open bucket is the
    highest finite bound; a group without observations has none.
    """
    order = Window.partitionBy(*by).orderBy("le")
    rank = F.lit(q) * F.max("cumulative").over(Window.partitionBy(*by))
    below = F.coalesce(F.lag("cumulative").over(order), F.lit(0))
    edge = F.coalesce(F.lag("le").over(order), F.lit(0.0))
    marked = (
        histogram.withColumn("_rank", rank).withColumn("_below", below).withColumn("_edge", edge)
    )
    inside = marked.filter((F.col("cumulative") >= F.col("_rank")) & (F.col("_rank") > 0))
    first = inside.groupBy(*by).agg(
        F.min_by(F.struct("le", "_edge", "_below", "cumulative", "_rank"), "le").alias("b")
    )
    part = F.try_divide(F.col("b._rank") - F.col("b._below"), F.col("b.cumulative") - F.col("b._below"))
    value = F.when(F.col("b.le") == float("inf"), F.col("b._edge")).otherwise(
        F.col("b._edge") + (F.col("b.le") - F.col("b._edge")) * part
    )
    return first.select(*by, value.alias("quantile"))


def latency_percentiles(
    requests: DataFrame, by: Sequence[str] = ("endpoint",), approximate: bool = False
) -> DataFrame:
    """P95 and P99 latency per group, exact or from a sketch."""
    if approximate:
        found = F.percentile_approx("latency_s", [0.95, 0.99], 10_000)
        return requests.groupBy(*by).agg(found.alias("_p")).select(
            *by, F.col("_p")[0].alias("p95"), F.col("_p")[1].alias("p99")
        )
    return exact_percentiles(requests, "latency_s", [0.95, 0.99], ["p95", "p99"], by)


def error_rate(requests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Server errors per hundred requests: both sides are summed, then divided."""
    status = F.coalesce("status", F.lit(500))
    return requests.groupBy(*by).agg(
        F.count_if(is_error(status)).alias("errors"),
        F.count("*").alias("requests"),
        percent(F.count_if(is_error(status)), F.count("*")).alias("error_rate_pct"),
    )


def cache_hit_rate(requests: DataFrame, by: Sequence[str] = ("cache_type",)) -> DataFrame:
    return requests.groupBy(*by).agg(
        F.count_if("cache_hit").alias("hits"),
        F.count("*").alias("lookups"),
        percent(F.count_if("cache_hit"), F.count("*")).alias("cache_hit_pct"),
    )


def _slid(
    rows: DataFrame, span: str, step: str, by: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """(_window, *by, sums) of sliding windows of `ts`.

    Rows are summed up per pane, the longest stretch that every window has whole
    or not at all; only the panes are copied to the windows that hold them.
    """
    widths = [pd.Timedelta(t) // pd.Timedelta(microseconds=1) for t in (span, step)]
    pane = F.window("ts", f"{math.gcd(*widths)} microseconds").alias("_pane")
    panes = rows.groupBy(pane, *by).agg(*[c.alias(name) for name, c in sums.items()])
    window = F.window(F.window_time("_pane"), span, step).alias("_window")
    return panes.groupBy(window, *by).agg(*[F.sum(name).alias(name) for name in sums])


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.col(total), F.col(n))


def window_rates(
    requests: DataFrame,
    span: str = "5 minutes",
    step: str = "30 seconds",
    by: Sequence[str] = (),
) -> DataFrame:
    """Sliding windows with requests, errors, mean latency and queries per second."""
    status = F.coalesce("status", F.lit(500))
    # By rows: sums of panes round apart from the mean of the rows at a tie.
    counted = requests.groupBy(F.window("ts", span, step).alias("_window"), *by).agg(
        F.count("*").alias("requests"),
        F.count_if(is_error(status)).alias("errors"),
        F.avg("latency_s").alias("mean_latency_s"),
    )
    seconds = F.timestamp_diff("SECOND", F.col("_window.start"), F.col("_window.end"))
    return counted.select(
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        *by,
        "requests",
        "errors",
        "mean_latency_s",
        (F.col("requests") / seconds).alias("qps"),
        percent(F.col("errors"), F.col("requests")).alias("error_rate_pct"),
    )


def stage_latency(
    stages: DataFrame, span: str = "5 minutes", step: str = "30 seconds", stage: str = "stage"
) -> DataFrame:
    """Mean latency per window and stage: the rate of the sum over that of the count."""
    sums = {"observations": F.count("*"), "_latency": F.sum("latency_s"), "_timed": F.count("latency_s")}
    return _slid(stages, span, step, [stage], sums).select(
        F.col("_window.start").alias("window_start"),
        stage,
        _mean("_latency", "_timed").alias("mean_latency_s"),
        "observations",
    )


def counter_increase(
    samples: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    span: str = "5 minutes",
    step: str = "30 seconds",
) -> DataFrame:
    """Increase of a counter per series and window, minding resets.

    A value below the one before is a restart and counts whole; the first
    sample of a series adds nothing. No extrapolation to the window's edges.
    """
    steps = lag_in_slices(samples, series, order, "value", "_before")
    delta = F.when(F.col("value") < F.col("_before"), F.col("value")).otherwise(
        F.col("value") - F.col("_before")
    )
    sums = {"increase": F.sum(F.coalesce(delta, F.lit(0.0))), "samples": F.count("*")}
    return _slid(steps, span, step, series, sums).select(
        F.col("_window.start").alias("window_start"), *series, "increase", "samples"
    )


def gauge_last(
    samples: DataFrame, series: Sequence[str], value: str, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """The latest value of each series, and its mean."""
    return samples.groupBy(*series).agg(
        F.max_by(value, F.struct(*order)).alias("last_value"),
        F.avg(value).alias("mean_value"),
    )


def service_figures(requests: DataFrame, stages: Mapping[str, str] | None = None) -> DataFrame:
    """The figures the dashboard and the objectives look at, as (metric, value).

    `stages` names stage percentiles with an SQL condition on the rows they cover.
    """
    status = F.coalesce("status", F.lit(500))
    length = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    totals = requests.agg(
        percent(F.count_if(is_error(status)), F.count("*")).alias("error_rate_pct"),
        percent(F.count_if("cache_hit"), F.count("*")).alias("cache_hit_pct"),
        F.try_divide(F.count("*"), length).alias("qps"),
        F.avg("cost_usd").alias("cost_per_query_usd"),
    )
    figures = ["error_rate_pct", "cache_hit_pct", "qps", "cost_per_query_usd"]
    result = totals.unpivot([], figures, "metric", "value")
    # All percentiles from one sort: a row counts for all requests and its stages.
    covers = [F.when(F.expr(c), F.lit(n)) for n, c in (stages or {}).items()]
    named = F.array_compact(F.array(F.lit("latency_s"), *covers))
    rows = requests.select(F.explode(named).alias("of"), "latency_s")
    found = exact_percentiles(rows, "latency_s", [0.95, 0.99], ["p95", "p99"], ["of"])
    every = F.col("of") == "latency_s"
    values = F.array(
        F.struct(F.when(every, "p95_latency_s").otherwise(F.col("of")).alias("metric"), F.col("p95").alias("value")),
        F.struct(F.when(every, "p99_latency_s").alias("metric"), F.col("p99").alias("value")),
    )
    percentiles = found.select(F.inline(values)).filter(F.col("metric").isNotNull())
    return result.unionByName(percentiles)


def slo_status(figures: DataFrame, panels: Mapping[str, tuple] = PANELS) -> DataFrame:
    """Dashboard colour of each figure that has a panel."""
    steps = figures.sparkSession.createDataFrame(
        [(m, low, high, *colours) for m, (low, high, colours) in panels.items()],
        "metric string, low double, high double, c0 string, c1 string, c2 string",
    )
    colour = (
        F.when(F.col("value") >= F.col("high"), F.col("c2"))
        .when(F.col("value") >= F.col("low"), F.col("c1"))
        .otherwise(F.col("c0"))
    )
    return figures.join(steps, "metric").select("metric", "value", colour.alias("status"))


def slo_report(figures: DataFrame, objectives: Mapping[str, tuple] = OBJECTIVES) -> DataFrame:
    """Pass or fail of each objective that has a figure."""
    rules = figures.sparkSession.createDataFrame(
        [(m, sign, bound) for m, (sign, bound) in objectives.items()],
        "metric string, sign string, bound double",
    )
    met = F.when(F.col("sign") == "<", F.col("value") < F.col("bound")).otherwise(
        F.col("value") > F.col("bound")
    )
    return figures.join(rules, "metric").select("metric", "value", "sign", "bound", met.alias("passed"))


def alert_for(
    evaluations: DataFrame,
    condition: Column,
    hold_seconds: int = 300,
    step_seconds: int = 30,
    series: Sequence[str] = (),
    ts: str = "window_start",
) -> DataFrame:
    """State of an alert at each evaluation: inactive, pending or firing.

    It fires once the condition has held without a break for `hold_seconds`;
    a missing evaluation is a break. Takes windowed metrics, that is a row per
    series and step, not raw events.
    """
    order = Window.partitionBy(*series).orderBy(ts)
    active = F.coalesce(condition, F.lit(False))
    gap = F.timestamp_diff("SECOND", F.lag(ts).over(order), F.col(ts)) > step_seconds
    starts = active & (
        ~F.coalesce(F.lag("_active").over(order), F.lit(False)) | F.coalesce(gap, F.lit(True))
    )
    marked = evaluations.withColumn("_active", active).withColumn("_start", starts)
    since = F.max(F.when(F.col("_start"), F.col(ts))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    held = F.timestamp_diff("SECOND", F.col("_since"), F.col(ts))
    state = (
        F.when(~F.col("_active"), "inactive")
        .when(held >= hold_seconds, "firing")
        .otherwise("pending")
    )
    return (
        marked.withColumn("_since", since)
        .withColumn("state", state)
        .withColumn("active_since", F.when(F.col("_active"), F.col("_since")))
        .drop("_active", "_start", "_since")
    )


def with_silences(
    evaluations: DataFrame, value: str, step_seconds: int = 30, series: Sequence[str] = (), ts: str = "window_start"
) -> DataFrame:
    """(*series, ts, value) with a row without a value where a series falls silent.

    That is the first step without an evaluation: between two evaluations, and
    after the last one if any series goes on so long. An alert is resolved there
    instead of keeping its last state. Rows without a moment are left out, and
    repeated moments of a series give one silence at most.
    """
    rows = evaluations.select(*series, ts, value).filter(F.col(ts).isNotNull())
    # As text, so that a time without a zone stays one.
    latest = rows.agg(F.max(ts).cast("string")).first()[0]
    until = F.lit(latest).cast(rows.schema[ts].dataType)
    missing = F.col(ts) + F.make_dt_interval(secs=F.lit(step_seconds))
    following = F.lead(ts).over(Window.partitionBy(*series).orderBy(ts))
    silent = F.when(following.isNull(), missing <= until).otherwise(following > missing)
    none = F.lit(None).cast(rows.schema[value].dataType)
    moments = F.array(
        F.struct(F.col(ts).alias(ts), F.col(value).alias(value)),
        F.when(F.col("_silent"), F.struct(missing.alias(ts), none.alias(value))),
    )
    return rows.withColumn("_silent", silent).select(*series, F.inline(F.array_compact(moments)))


def canary_assign(requests: DataFrame, key: str, weight: int = 10) -> DataFrame:
    """Send `weight` percent of the keys to the canary, always the same ones."""
    digest = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    bucket = F.conv(digest, 16, 10).cast("bigint") % 100
    return requests.withColumn("arm", F.when(bucket < weight, "canary").otherwise("stable"))


def canary_compare(
    requests: DataFrame, max_error_gap_pct: float = 1.0, max_latency_ratio: float = 1.2
) -> DataFrame:
    """Success and latency of both arms, and whether to roll the canary back."""
    status = F.coalesce("status", F.lit(500))
    canary, stable = F.col("arm") == "canary", F.col("arm") == "stable"

    def success(arm: Column) -> Column:
        return percent(F.count_if(arm & ~is_error(status)), F.count_if(arm))

    sides = requests.agg(
        success(canary).alias("canary_success_pct"),
        success(stable).alias("stable_success_pct"),
        F.avg(F.when(canary, F.col("latency_s"))).alias("canary_latency_s"),
        F.avg(F.when(stable, F.col("latency_s"))).alias("stable_latency_s"),
    )
    worse = F.col("stable_success_pct") - F.col("canary_success_pct") > max_error_gap_pct
    slower = F.col("canary_latency_s") > F.col("stable_latency_s") * max_latency_ratio
    return sides.select(
        "*",
        (F.col("canary_latency_s") - F.col("stable_latency_s")).alias("latency_difference_s"),
        F.coalesce(worse | slower, F.lit(False)).alias("rollback"),
    )


def answer_envelope(rows: DataFrame) -> DataFrame:
    """Response fields: the answer or its stand-in, and the question's length."""
    return rows.withColumn(
        "answer", F.coalesce("answer", F.lit("No answer generated"))
    ).withColumn("question_length", F.char_length(F.coalesce("question", F.lit(""))))
