"""Sliding request metrics over a stream of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators.service import window_rates


def stream_rates(
    requests: DataFrame,
    watermark: str = "1 minute",
    span: str = "5 minutes",
    step: str = "30 seconds",
    by: Sequence[str] = (),
) -> DataFrame:
    """`window_rates` on a stream; rows later than the watermark are dropped.

    In append mode each window comes out once, when it is closed.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    return window_rates(timed.withWatermark("ts", watermark), span, step, by)
