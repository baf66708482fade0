"""Service figures on small logs, and the cache replay against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quaestor.operators import service as sv
from quaestor.operators.cache_replay import cache_misses, ttl_cache_replay

REQUEST = "ts timestamp, method string, endpoint string, status int, latency_s double, cache_hit boolean, cost_usd double"
START = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame(
        [(START + dt.timedelta(seconds=s), "POST", e, status, latency, hit, 0.01) for s, e, status, latency, hit in rows], REQUEST
    )


@pytest.fixture
def requests(spark):
    return log(
        spark,
        [(0, "a", 200, 0.004, True), (10, "a", 503, 0.3, False), (20, "a", None, 12.0, False), (30, "b", 404, 20.0, True)],
    )


def test_counts_and_rates(requests):
    counts = {(r.endpoint, r.status): r.requests for r in sv.request_counts(requests).collect()}
    assert counts == {("a", 200): 1, ("a", 503): 1, ("a", 500): 1, ("b", 404): 1}
    rates = {r.endpoint: r.error_rate_pct for r in sv.error_rate(requests, ["endpoint"]).collect()}
    assert {k: round(v, 4) for k, v in rates.items()} == {"a": 66.6667, "b": 0.0}
    hits = sv.cache_hit_rate(requests, []).first()
    assert (hits.hits, hits.lookups, hits.cache_hit_pct) == (2, 4, 50.0)
    none = requests.limit(0)
    assert sv.error_rate(none).first().error_rate_pct == 0.0
    assert sv.latency_histogram(none).isEmpty()
    assert sv.canary_compare(sv.canary_assign(none, "endpoint")).first().rollback is False


def test_histogram_and_quantile(spark, requests):
    histogram = sv.latency_histogram(requests)
    a = [r.cumulative for r in histogram.filter("endpoint = 'a'").orderBy("le").collect()]
    assert a == [1] * 6 + [1] + [2] * 7 + [3]
    half = {r.endpoint: r.quantile for r in sv.histogram_quantile(histogram, 0.5).collect()}
    # rank 1.5 of 3 lies halfway in the bucket from 0.25 to 0.5; b only has the open bucket
    assert half == {"a": 0.375, "b": 10.0}
    first = sv.histogram_quantile(histogram, 0.1).filter("endpoint = 'a'").first().quantile
    assert abs(first - 0.0015) < 1e-12


def test_windows(requests):
    rows = {r.window_start: r for r in sv.window_rates(requests, "20 seconds", "10 seconds").collect()}
    assert len(rows) == 5
    assert rows[START].requests == 2 and rows[START].errors == 1 and rows[START].qps == 0.1
    assert rows[START + dt.timedelta(seconds=10)].errors == 2


def test_counter_resets_gaps_and_single_samples(spark):
    samples = [("r", 0, 5.0), ("r", 10, 8.0), ("r", 20, 2.0), ("r", 30, 2.0), ("r", 200, 10.0), ("one", 0, 7.0)]
    df = spark.createDataFrame([(s, START + dt.timedelta(seconds=t), v) for s, t, v in samples], "series string, ts timestamp, value double")
    grown = sv.counter_increase(df, ["series"], ["ts"], "1 minute", "1 minute")
    got = {(r.series, (r.window_start - START).seconds): r.increase for r in grown.collect()}
    assert got == {("r", 0): 5.0, ("r", 180): 8.0, ("one", 0): 0.0}


def test_figures_status_and_report(spark):
    rows = [(i, "view" if i % 2 else "buy", 500 if i == 3 else 200, i / 10, i < 9) for i in range(11)]
    figures = sv.service_figures(log(spark, rows), {"retrieval_p95_s": "endpoint = 'view'"})
    values = {r.metric: round(r.value, 6) for r in figures.collect()}
    assert values["qps"] == 1.1 and values["p95_latency_s"] == 0.95 and values["retrieval_p95_s"] == 0.86
    status = {r.metric: r.status for r in sv.slo_status(figures).collect()}
    assert status == {
        "p95_latency_s": "green", "error_rate_pct": "red", "cache_hit_pct": "green", "qps": "red", "cost_per_query_usd": "yellow",
    }
    report = {r.metric: r.passed for r in sv.slo_report(figures).collect()}
    assert report == {
        "p95_latency_s": True, "p99_latency_s": True, "error_rate_pct": False, "retrieval_p95_s": True, "cache_hit_pct": True,
    }


def test_alert_needs_an_unbroken_hold(spark):
    # (minute, active); the ninth minute is missing for series "gap"
    pattern = {"five": "0111111000", "four": "0111110000", "break": "1110111111", "gap": "111111110 11111"}
    rows = [
        (s, START + dt.timedelta(minutes=m), 3.0 if c == "1" else 1.0)
        for s, text in pattern.items() for m, c in enumerate(text) if c != " "
    ]
    df = spark.createDataFrame(rows, "series string, window_start timestamp, value double")
    states = sv.alert_for(df, F.col("value") > 2, 300, 60, ["series"])
    got = {}
    for r in states.orderBy("series", "window_start").collect():
        got[r.series] = got.get(r.series, "") + r.state[0]
    assert got["five"] == "ipppppfiii"
    assert got["four"] == "ipppppiiii"
    assert got["break"] == "pppippppp" + "f"
    assert got["gap"] == "pppppfffi" + "ppppp"


def test_canary(spark):
    df = spark.range(5000).select(F.col("id").alias("user_id"))
    arms = sv.canary_assign(df, "user_id")
    assert arms.exceptAll(sv.canary_assign(df, "user_id")).isEmpty()
    assert 0.07 < arms.filter("arm = 'canary'").count() / 5000 < 0.13
    sides = spark.createDataFrame(
        [("canary", 500, 1.0), ("canary", 200, 3.0), ("stable", 200, 1.0)], "arm string, status int, latency_s double"
    )
    row = sv.canary_compare(sides).first()
    assert (row.canary_success_pct, row.stable_success_pct, row.latency_difference_s, row.rollback) == (50.0, 100.0, 1.0, True)


def test_gauge_and_envelope(spark):
    df = spark.createDataFrame([("g", 1, 1, 0.5), ("g", 2, 1, 0.7), ("g", 2, 0, 0.9)], "series string, ts int, id int, v double")
    row = sv.gauge_last(df, ["series"], "v", ["ts", "id"]).first()
    assert row.last_value == 0.7 and round(row.mean_value, 6) == 0.7
    pairs = spark.createDataFrame([("why", None), (None, "so")], "question string, answer string")
    rows = [tuple(r) for r in sv.answer_envelope(pairs).collect()]
    assert rows == [("why", "No answer generated", 3), (None, "so", 0)]


def replay(rows, ttl, carried=()):
    expires, labels = dict(carried), {}
    for at, request, key in sorted((at, request, key) for request, key, at in rows):
        labels[request] = key in expires and at < expires[key]
        if not labels[request]:
            expires[key] = at + ttl
    return labels


LOG = "request_id long, key string, at long"


@pytest.mark.parametrize("max_fold", [1000, 0])
def test_replay_at_the_edges(spark, max_fold):
    rows = [(1, "k", 0), (2, "k", 9), (3, "k", 10), (4, "k", 19), (5, "k", 21), (6, "k", 21), (7, "solo", 5)]
    got = ttl_cache_replay(spark.createDataFrame(rows, LOG), 10, max_fold=max_fold)
    labels = {r.request_id: r.cache_hit for r in got.collect()}
    # a hit at 9 or 19 does not extend the entry; the time to live itself is a miss
    assert labels == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False} == replay(rows, 10)


@pytest.mark.parametrize("max_fold", [1000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_replay_matches_a_loop(spark, max_fold, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["mild"] * 2 + ["x", "y"]
    rows = [(i, rng.choice(keys), rng.choice([rng.randrange(500), rng.randrange(4000)])) for i in range(700)]
    carried = [("hot", 37), ("gone", 9), ("x", 2500)]
    df = spark.createDataFrame(rows, LOG).repartition(5)
    state = spark.createDataFrame(carried, "key string, expires long")
    for ttl in (1, 7, 60):
        got = ttl_cache_replay(df, ttl, max_fold=max_fold, carried=state)
        assert {r.request_id: r.cache_hit for r in got.collect()} == replay(rows, ttl, carried)


def test_replay_of_an_empty_log(spark):
    assert cache_misses(spark.createDataFrame([], LOG), 10).isEmpty()


@pytest.mark.parametrize(("span", "step"), [("1 hour", "30 minutes"), ("5 minutes", "2 minutes"), ("1 minute", "1 minute")])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_panes_give_the_windows_of_the_rows(spark, span, step, kind):
    log = spark.range(400).select(
        (F.timestamp_seconds(1_700_000_000 + F.col("id") * F.col("id") % 7919)).cast(kind).alias("ts"),
        F.when(F.col("id") % 5 == 0, F.lit(500)).when(F.col("id") % 7 != 0, F.lit(200)).alias("status"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 13).cast("double")).alias("latency_s"),
        F.when(F.col("id") % 3 != 0, F.lit("a")).alias("part"),
    )
    log = log.unionByName(log.limit(3).withColumn("ts", F.lit(None).cast(kind)))
    got = sv.stage_latency(log, span, step, "part")
    want = log.groupBy(F.window("ts", span, step).alias("w"), "part").agg(
        F.count("*").alias("observations"), F.avg("latency_s").alias("mean_latency_s")
    )
    key = lambda r: tuple(str(x) for x in r)
    columns = ["part", "observations", F.round("mean_latency_s", 9)]
    assert sorted(got.select("window_start", *columns).collect(), key=key) == sorted(
        want.select("w.start", *columns).collect(), key=key
    )
    assert sv.stage_latency(log.limit(0), span, step, "part").collect() == []


def test_rows_are_not_copied_to_windows(spark):
    """Only sums of panes reach the step that makes several windows of one."""
    log = spark.range(1000).select(
        F.timestamp_seconds("id").alias("ts"), F.lit("s").alias("stage"), F.lit(1.0).alias("latency_s")
    )
    plan = sv.stage_latency(log)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    copies = [i for i, line in enumerate(plan) if "Expand" in line or "Generate" in line]
    sums = [i for i, line in enumerate(plan) if "Aggregate" in line]
    assert copies and len(sums) == 2 and sums[0] < min(copies) and max(copies) < sums[1]
