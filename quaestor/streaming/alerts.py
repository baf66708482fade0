"""Alert state over a stream of evaluations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series string, at long, state string, active_since long"
STATE = "active_since long, last_at long"


def alert_stream(
    evaluations: DataFrame,
    threshold: float,
    hold: int = 300,
    step: int = 30,
    late: int | None = None,
) -> DataFrame:
    """State of one alert per series: inactive, pending or firing.

    Takes (series, at, value) with `at` in seconds, a row per series and step
    as closed windows give them. The state kept per series is two numbers. A
    row at or before the last one judged is late and left out: its moment has
    its state already.

    With `late`, silence resolves an alert as in `with_silences`: the first step
    without an evaluation is inactive. It comes out once the other series are
    `late` seconds past it, or before the series' next row, and the state of a
    silent series is dropped. Moments are then after the year 1970 began, where
    watermarks start.
    """
    resolving = late is not None
    if resolving:
        timed = evaluations.withColumn("_time", F.timestamp_seconds("at"))
        evaluations = timed.withWatermark("_time", f"{late} seconds")

    def advance(
        key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        since, last = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.remove()
            yield silence(key[0], last + step)
            return
        rows = pd.concat(list(frames))[["at", "value"]].sort_values("at")
        if last is not None:
            rows = rows[rows["at"] > last]
        if rows.empty:
            if resolving and last is not None:
                wait(state, last)
            return
        if resolving:
            rows = with_missing(rows, last)
        at = rows["at"].to_numpy()
        active = (rows["value"] > threshold).to_numpy()
        was = np.append(since is not None, active[:-1])
        gap = np.diff(at, prepend=at[0] - step - 1 if last is None else last) > step
        # Each moment's last start: of this batch, or the one carried over.
        number = np.cumsum(active & (~was | gap))
        starts = np.append(0 if since is None else since, at[active & (~was | gap)])
        begun = starts[number]
        held = np.where(at - begun >= hold, "firing", "pending")
        state.update((int(begun[-1]) if active[-1] else None, int(at[-1])))
        if resolving:
            wait(state, int(at[-1]))
        yield pd.DataFrame(
            {
                "series": key[0],
                "at": at,
                "state": np.where(active, held, "inactive"),
                "active_since": pd.array(np.where(active, begun, 0), dtype="Int64"),
            }
        ).assign(active_since=lambda f: f["active_since"].mask(~active))

    def with_missing(rows: pd.DataFrame, last: int | None) -> pd.DataFrame:
        """The rows and the first missing step of each gap before them."""
        before = rows["at"].shift(fill_value=rows["at"].iloc[0] if last is None else last)
        first = before[rows["at"] - before > step] + step
        missing = pd.DataFrame({"at": first, "value": np.nan})
        return pd.concat([rows, missing]).sort_values("at") if len(missing) else rows

    def wait(state: GroupState, last: int) -> None:
        state.setTimeoutTimestamp(max((last + step) * 1000, state.getCurrentWatermarkMs() + 1))

    def silence(series: str, at: int) -> pd.DataFrame:
        none = pd.array([None], dtype="Int64")
        return pd.DataFrame({"series": [series], "at": [at], "state": ["inactive"], "active_since": none})

    timeout = GroupStateTimeout.EventTimeTimeout if resolving else GroupStateTimeout.NoTimeout
    return evaluations.groupBy("series").applyInPandasWithState(advance, OUTPUT, STATE, "append", timeout)
