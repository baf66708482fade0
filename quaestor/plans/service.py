"""Service analytics over `events` read as a request log.

The event type is the endpoint, errors are 500s, value / 30 is the latency in
seconds and value / 10000 the cost in dollars; answers under a second and a
half came from the cache. Windows are an hour every half hour, as the log has
an event every few minutes. Times leave as seconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import service as sv
from quaestor.operators.cache_replay import TTL_SECONDS
from quaestor.operators.cache_replay import ttl_cache_replay as replay
from quaestor.plans.common import epoch_micros, epoch_seconds
from quaestor.plans.registry import query, table

SPAN, STEP = "1 hour", "30 minutes"
STEP_S = 1800

REQUESTS_SQL = """requests AS (
  SELECT event_id, ts, user_id, event_type AS endpoint, 'POST' AS method,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
         value / 30 AS latency_s, value / 30 < 1.5 AS cache_hit, value / 10000 AS cost_usd FROM events)"""

# A time falls into the window that starts on its half hour and the one before.
WINDOWS_SQL = (
    REQUESTS_SQL
    + """,
windows AS (SELECT r.*, epoch(time_bucket(INTERVAL '30 minutes', ts))::BIGINT - 1800 * b AS window_start
  FROM requests r, range(0, 2) AS s(b))"""
)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value")
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("endpoint"),
        F.lit("POST").alias("method"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (value / 30).alias("latency_s"),
        (value / 30 < 1.5).alias("cache_hit"),
        (value / 10000).alias("cost_usd"),
    )


def _start(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", epoch_seconds(F.col("window_start")))


@query(
    "request_counts",
    f"WITH {REQUESTS_SQL} SELECT method, endpoint, status, count(*) AS requests FROM requests GROUP BY ALL",
)
def request_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sv.request_counts(requests(spark, folder))


HISTOGRAM_SQL = (
    REQUESTS_SQL
    + """,
bounds AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10, 'inf'::DOUBLE]) AS le),
histogram AS (SELECT endpoint, le, count(*) FILTER (latency_s <= le) AS cumulative,
  sum(latency_s) AS total_s, count(*) AS observations FROM requests, bounds GROUP BY endpoint, le)"""
)


@query(
    "latency_histogram",
    f"""WITH {HISTOGRAM_SQL}
SELECT endpoint, CASE WHEN isinf(le) THEN '+Inf' ELSE 'finite' END AS kind, CASE WHEN isinf(le) THEN NULL ELSE le END AS le,
  cumulative, round(total_s, 4) AS total_s, observations FROM histogram""",
)
def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    le = F.col("le")
    return sv.latency_histogram(requests(spark, folder)).select(
        "endpoint",
        F.when(le == float("inf"), "+Inf").otherwise("finite").alias("kind"),
        F.when(le != float("inf"), le).alias("le"),
        "cumulative",
        F.round("total_s", 4).alias("total_s"),
        "observations",
    )


QUANTILE_SQL = """marked AS (SELECT *, 0.95::DOUBLE * max(cumulative) OVER (PARTITION BY {by}) AS target,
  coalesce(lag(cumulative) OVER (PARTITION BY {by} ORDER BY le), 0) AS below,
  coalesce(lag(le) OVER (PARTITION BY {by} ORDER BY le), 0) AS edge FROM histogram),
quantiles AS (SELECT {by}, CASE WHEN isinf(le) THEN edge ELSE edge + (le - edge) * (target - below) / (cumulative - below) END AS quantile
  FROM marked WHERE cumulative >= target
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY le) = 1)"""


@query(
    "histogram_quantile",
    f"""WITH {HISTOGRAM_SQL}, {QUANTILE_SQL.format(by='endpoint')}
SELECT endpoint, round(quantile, 6) AS quantile FROM quantiles""",
)
def histogram_quantile(spark: SparkSession, folder: str) -> DataFrame:
    histogram = sv.latency_histogram(requests(spark, folder))
    return sv.histogram_quantile(histogram, 0.95).withColumn("quantile", F.round("quantile", 6))


@query(
    "latency_percentiles",
    f"""WITH {REQUESTS_SQL}
SELECT endpoint, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(quantile_cont(latency_s, 0.99), 6) AS p99
FROM requests GROUP BY endpoint""",
)
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    found = sv.latency_percentiles(requests(spark, folder))
    return found.withColumns({"p95": F.round("p95", 6), "p99": F.round("p99", 6)})


@query(
    "error_rate",
    f"""WITH {REQUESTS_SQL}
SELECT user_id, count(*) FILTER (status BETWEEN 500 AND 599) AS errors, count(*) AS requests,
  round(count(*) FILTER (status BETWEEN 500 AND 599) / count(*) * 100, 6) AS error_rate_pct FROM requests GROUP BY user_id""",
)
def error_rate(spark: SparkSession, folder: str) -> DataFrame:
    rates = sv.error_rate(requests(spark, folder), ["user_id"])
    return rates.withColumn("error_rate_pct", F.round("error_rate_pct", 6))


@query(
    "cache_hit_rate",
    f"""WITH {REQUESTS_SQL}
SELECT endpoint AS cache_type, count(*) FILTER (cache_hit) AS hits, count(*) AS lookups,
  round(count(*) FILTER (cache_hit) / count(*) * 100, 6) AS cache_hit_pct FROM requests GROUP BY endpoint""",
)
def cache_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    typed = requests(spark, folder).withColumnRenamed("endpoint", "cache_type")
    return sv.cache_hit_rate(typed).withColumn("cache_hit_pct", F.round("cache_hit_pct", 6))


@query(
    "qps_windows",
    f"""WITH {WINDOWS_SQL}
SELECT window_start, count(*) AS requests, count(*) FILTER (status = 500) AS errors,
  round(avg(latency_s), 6) AS mean_latency_s, round(count(*) / 3600, 9) AS qps,
  round(count(*) FILTER (status = 500) / count(*) * 100, 6) AS error_rate_pct FROM windows GROUP BY window_start""",
)
def qps_windows(spark: SparkSession, folder: str) -> DataFrame:
    rates = sv.window_rates(requests(spark, folder), SPAN, STEP).drop("window_end")
    return _start(rates).withColumns(
        {
            "mean_latency_s": F.round("mean_latency_s", 6),
            "qps": F.round("qps", 9),
            "error_rate_pct": F.round("error_rate_pct", 6),
        }
    )


@query(
    "stage_latency",
    f"""WITH {WINDOWS_SQL}
SELECT window_start, endpoint AS stage, round(avg(latency_s), 6) AS mean_latency_s, count(*) AS observations
FROM windows GROUP BY window_start, endpoint""",
)
def stage_latency(spark: SparkSession, folder: str) -> DataFrame:
    stages = requests(spark, folder).withColumnRenamed("endpoint", "stage")
    means = sv.stage_latency(stages, SPAN, STEP)
    return _start(means).withColumn("mean_latency_s", F.round("mean_latency_s", 6))


@query(
    "counter_increase",
    """WITH samples AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events),
deltas AS (SELECT event_type AS series, epoch(time_bucket(INTERVAL '30 minutes', ts))::BIGINT - 1800 * b AS window_start,
  coalesce(CASE WHEN value < before THEN value ELSE value - before END, 0) AS delta FROM samples, range(0, 2) AS s(b))
SELECT window_start, series, round(sum(delta), 6) AS increase, count(*) AS samples FROM deltas GROUP BY window_start, series""",
)
def counter_increase(spark: SparkSession, folder: str) -> DataFrame:
    """Event values as samples of one counter per type, every fall a restart."""
    samples = table(spark, folder, "events").withColumnRenamed("event_type", "series")
    grown = sv.counter_increase(samples, ["series"], ["ts", "event_id"], SPAN, STEP)
    return _start(grown).withColumn("increase", F.round("increase", 6))


@query(
    "gauge_last",
    f"""WITH {REQUESTS_SQL}
SELECT endpoint, arg_max(cost_usd, (ts, event_id)) AS last_value, round(avg(cost_usd), 9) AS mean_value
FROM requests GROUP BY endpoint""",
)
def gauge_last(spark: SparkSession, folder: str) -> DataFrame:
    gauges = sv.gauge_last(requests(spark, folder), ["endpoint"], "cost_usd", ["ts", "event_id"])
    return gauges.withColumn("mean_value", F.round("mean_value", 9))


STAGES = {"retrieval_p95_s": "endpoint = 'view'", "generation_p95_s": "endpoint = 'purchase'"}

FIGURES_SQL = (
    REQUESTS_SQL
    + """,
figures AS (
  SELECT 'error_rate_pct' AS metric, count(*) FILTER (status = 500) / count(*) * 100 AS value FROM requests
  UNION ALL SELECT 'cache_hit_pct', count(*) FILTER (cache_hit) / count(*) * 100 FROM requests
  UNION ALL SELECT 'qps', count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000 FROM requests
  UNION ALL SELECT 'cost_per_query_usd', avg(cost_usd) FROM requests
  UNION ALL SELECT 'p95_latency_s', quantile_cont(latency_s, 0.95) FROM requests
  UNION ALL SELECT 'p99_latency_s', quantile_cont(latency_s, 0.99) FROM requests
  UNION ALL SELECT 'retrieval_p95_s', quantile_cont(latency_s, 0.95) FROM requests WHERE endpoint = 'view'
  UNION ALL SELECT 'generation_p95_s', quantile_cont(latency_s, 0.95) FROM requests WHERE endpoint = 'purchase')"""
)


@query(
    "slo_status",
    f"""WITH {FIGURES_SQL},
panels(metric, low, high, c0, c1, c2) AS (VALUES
  ('p95_latency_s', 1.0::DOUBLE, 2.0::DOUBLE, 'green', 'yellow', 'red'), ('error_rate_pct', 0.5, 1.0, 'green', 'yellow', 'red'),
  ('cache_hit_pct', 30, 50, 'red', 'yellow', 'green'), ('qps', 10, 50, 'red', 'yellow', 'green'),
  ('cost_per_query_usd', 0.01, 0.05, 'green', 'yellow', 'red'))
SELECT metric, round(value, 5) AS value, CASE WHEN value >= high THEN c2 WHEN value >= low THEN c1 ELSE c0 END AS status
FROM figures JOIN panels USING (metric)""",
)
def slo_status(spark: SparkSession, folder: str) -> DataFrame:
    figures = sv.service_figures(requests(spark, folder), STAGES)
    return sv.slo_status(figures).withColumn("value", F.round("value", 5))


@query(
    "slo_report",
    f"""WITH {FIGURES_SQL},
rules(metric, sign, bound) AS (VALUES ('p95_latency_s', '<', 2.0::DOUBLE), ('p99_latency_s', '<', 5.0), ('error_rate_pct', '<', 1.0),
  ('retrieval_p95_s', '<', 1.0), ('generation_p95_s', '<', 3.0), ('cache_hit_pct', '>', 80.0))
SELECT metric, round(value, 5) AS value, sign, bound, CASE sign WHEN '<' THEN value < bound ELSE value > bound END AS passed
FROM figures JOIN rules USING (metric)""",
)
def slo_report(spark: SparkSession, folder: str) -> DataFrame:
    figures = sv.service_figures(requests(spark, folder), STAGES)
    return sv.slo_report(figures).withColumn("value", F.round("value", 5))


@query(
    "alert_for",
    f"""WITH {WINDOWS_SQL},
bounds AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10, 'inf'::DOUBLE]) AS le),
histogram AS (SELECT window_start, le, count(*) FILTER (latency_s <= le) AS cumulative FROM windows, bounds GROUP BY window_start, le),
{QUANTILE_SQL.format(by='window_start')},
active AS (SELECT window_start, quantile > 5.0 AS active,
  lag(quantile > 5.0) OVER (ORDER BY window_start) AS was, window_start - lag(window_start) OVER (ORDER BY window_start) AS gap FROM quantiles),
since AS (SELECT *, max(CASE WHEN active AND (NOT coalesce(was, false) OR coalesce(gap > 1800, true)) THEN window_start END)
  OVER (ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS since FROM active)
SELECT window_start, CASE WHEN NOT active THEN 'inactive' WHEN window_start - since >= 5400 THEN 'firing' ELSE 'pending' END AS state,
  CASE WHEN active THEN since END AS active_since FROM since""",
)
def alert_for(spark: SparkSession, folder: str) -> DataFrame:
    """P95 from windowed histograms above 5 s, held for an hour and a half."""
    start = F.window("ts", SPAN, STEP)["start"]
    windowed = requests(spark, folder).withColumn("window_start", start)
    histogram = sv.latency_histogram(windowed, by=["window_start"])
    p95 = sv.histogram_quantile(histogram, 0.95, ["window_start"])
    states = sv.alert_for(p95, F.col("quantile") > 5.0, 3 * STEP_S, STEP_S)
    return _start(states).select(
        "window_start", "state", epoch_seconds(F.col("active_since")).alias("active_since")
    )


@query(
    "alert_silence",
    f"""WITH {WINDOWS_SQL},
means AS (SELECT endpoint AS series, window_start, avg(latency_s) AS value FROM windows GROUP BY ALL),
nexts AS (SELECT *, lead(window_start) OVER (PARTITION BY series ORDER BY window_start) AS following FROM means),
filled AS (SELECT series, window_start, value FROM means UNION ALL
  SELECT series, window_start + 1800, NULL FROM nexts
  WHERE CASE WHEN following IS NULL THEN window_start + 1800 <= (SELECT max(window_start) FROM means) ELSE following > window_start + 1800 END),
active AS (SELECT series, window_start, coalesce(value > 1.5, false) AS active,
  lag(coalesce(value > 1.5, false)) OVER (PARTITION BY series ORDER BY window_start) AS was,
  window_start - lag(window_start) OVER (PARTITION BY series ORDER BY window_start) AS gap FROM filled),
since AS (SELECT *, max(CASE WHEN active AND (NOT coalesce(was, false) OR coalesce(gap > 1800, true)) THEN window_start END)
  OVER (PARTITION BY series ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS since FROM active)
SELECT series, window_start, CASE WHEN NOT active THEN 'inactive' WHEN window_start - since >= 3600 THEN 'firing' ELSE 'pending' END AS state,
  CASE WHEN active THEN since END AS active_since FROM since""",
)
def alert_silence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean latency of each endpoint above 1.5 s for an hour; silence resolves."""
    stages = requests(spark, folder).withColumnRenamed("endpoint", "series")
    means = sv.stage_latency(stages, SPAN, STEP, "series")
    filled = sv.with_silences(means, "mean_latency_s", STEP_S, ["series"])
    states = sv.alert_for(filled, F.col("mean_latency_s") > 1.5, 2 * STEP_S, STEP_S, ["series"])
    return _start(states).select(
        "series", "window_start", "state", epoch_seconds(F.col("active_since")).alias("active_since")
    )


ARMS_SQL = (
    REQUESTS_SQL
    + """,
arms AS (SELECT *, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 100 < 10 THEN 'canary' ELSE 'stable' END AS arm FROM requests)"""
)


@query("canary_assign", f"WITH {ARMS_SQL} SELECT event_id, user_id, arm FROM arms")
def canary_assign(spark: SparkSession, folder: str) -> DataFrame:
    return sv.canary_assign(requests(spark, folder), "user_id").select("event_id", "user_id", "arm")


@query(
    "canary_compare",
    f"""WITH {ARMS_SQL},
sides AS (SELECT count(*) FILTER (arm = 'canary' AND status <> 500) / count(*) FILTER (arm = 'canary') * 100 AS c,
  count(*) FILTER (arm = 'stable' AND status <> 500) / count(*) FILTER (arm = 'stable') * 100 AS s,
  avg(latency_s) FILTER (arm = 'canary') AS cl, avg(latency_s) FILTER (arm = 'stable') AS sl FROM arms)
SELECT round(c, 6) AS canary_success_pct, round(s, 6) AS stable_success_pct, round(cl, 6) AS canary_latency_s,
  round(sl, 6) AS stable_latency_s, round(cl - sl, 6) AS latency_difference_s,
  coalesce(s - c > 1.0 OR cl > sl * 1.2::DOUBLE, false) AS rollback FROM sides""",
)
def canary_compare(spark: SparkSession, folder: str) -> DataFrame:
    sides = sv.canary_compare(sv.canary_assign(requests(spark, folder), "user_id"))
    return sides.withColumns({c: F.round(c, 6) for c in sides.columns if c != "rollback"})


def _replay_sql(key: str) -> str:
    return f"""WITH RECURSIVE misses(k, ts) AS (
  SELECT {key}, min(ts) FROM events GROUP BY {key}
  UNION ALL
  SELECT m.k, min(e.ts) FROM misses m JOIN events e ON e.{key} = m.k AND e.ts >= m.ts + INTERVAL 30 MINUTES GROUP BY m.k)
SELECT e.event_id, e.{key} AS key, NOT (m.k IS NOT NULL
  AND e.event_id = (SELECT min(x.event_id) FROM events x WHERE x.{key} = e.{key} AND x.ts = e.ts)) AS cache_hit
FROM events e LEFT JOIN misses m ON m.k = e.{key} AND m.ts = e.ts"""


@query("ttl_cache_replay", _replay_sql("user_id"))
def ttl_cache_replay(spark: SparkSession, folder: str) -> DataFrame:
    return _replay(spark, folder, "user_id", 10_000)


@query("ttl_cache_replay_busy", _replay_sql("event_type"))
def ttl_cache_replay_busy(spark: SparkSession, folder: str) -> DataFrame:
    """Few, busy keys: the chains are found with joins instead of folds."""
    return _replay(spark, folder, "event_type", 100)


def _replay(spark: SparkSession, folder: str, key: str, max_fold: int) -> DataFrame:
    log = table(spark, folder, "events").select(
        "event_id", F.col(key).alias("key"), epoch_micros(F.col("ts")).alias("at")
    )
    micros = TTL_SECONDS["answer"] * 1_000_000
    labelled = replay(log, micros, id_col="event_id", max_fold=max_fold)
    return labelled.select("event_id", "key", "cache_hit")


@query(
    "answer_envelope",
    """SELECT q.conv_id, q.turn, length(q.text) AS question_length, coalesce(a.text, 'No answer generated') AS answer
FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
WHERE q.role = 'user'""",
)
def answer_envelope(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    rows = sv.answer_envelope(asked.join(answers, ["conv_id", "turn"], "left"))
    return rows.select("conv_id", "turn", "question_length", "answer")
