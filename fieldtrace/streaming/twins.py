"""Structured Streaming twins of the stateful operators.

Event time is ``ts_us``. Rows later than the watermark are dropped by the engine, a
deviation from a sorted capture that the watermark delay bounds and
``counters.late_rows`` counts. Keyed state holds one anchor or one short list of times, and is evicted by
event-time timers. Connections are in ``flows``, sliding counts and expiry in ``counters``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldtrace.operators.sliced import seconds


def with_event_time(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def keyed_fold(df: DataFrame, keys: list[str], step: Callable, state: T.StructType, keep_us: int, out: list[str] | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Fold the rows of each key in time order through ``step(state, row) -> (state, outputs)``.

    Without a schema the rows that ``step`` returns are emitted as they came.
    """
    columns = out or [c for c in df.columns if c != "event_time"]
    result = schema or T.StructType([df.schema[c] for c in columns])

    def run(key, frames, group: GroupState):
        if group.hasTimedOut:
            group.remove()
            return
        now = group.get if group.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts_us", "seq"], kind="stable")
        made = []
        for row in rows.to_dict("records"):
            now, outputs = step(now, row)
            made.extend(outputs)
        group.update(now)
        group.setTimeoutTimestamp(int(max(rows["ts_us"].max() + keep_us, group.getCurrentWatermarkMs() * 1000) // 1000) + 1)
        if made:
            yield pd.DataFrame(made)[[f.name for f in result.fields]]
    return df.groupBy(*keys).applyInPandasWithState(run, result, state, "append", GroupStateTimeout.EventTimeTimeout)


_ANCHOR = T.StructType([T.StructField("anchor", T.LongType())])
_TIMES = T.StructType([T.StructField("times", T.ArrayType(T.LongType())), T.StructField("last", T.LongType())])


def suppress_stream(alerts: DataFrame, window_s: float = 60.0, keys=("anomaly_type", "src_ip", "dst_ip")) -> DataFrame:
    """First alert of each window, as :func:`fieldtrace.operators.alerts.suppress_repeats`."""
    gap = seconds(window_s)

    def step(state, row):
        if state is not None and 0 <= row["ts_us"] - state[0] < gap:
            return state, []
        return (row["ts_us"],), [row]
    return keyed_fold(alerts, list(keys), step, _ANCHOR, 10 * gap)


def scan_windows_stream(attempts: DataFrame, window_s: float = 10.0, keys=("src_ip",)) -> DataFrame:
    """Rows with the start of their anchored window (``mark_us``)."""
    gap = seconds(window_s)

    def step(state, row):
        if state is None or row["ts_us"] - state[0] > gap:
            state = (row["ts_us"],)
        return state, [{**row, "mark_us": state[0]}]
    columns = [attempts.schema[c] for c in attempts.columns if c != "event_time"]
    return keyed_fold(attempts, list(keys), step, _ANCHOR, 2 * gap, schema=T.StructType([*columns, T.StructField("mark_us", T.LongType())]))


def rate_stream(events: DataFrame, keys: list[str], window_s: float, limit: int) -> DataFrame:
    """Rows exceeding ``limit`` in the window, exact: the list of live times is the state."""
    window = seconds(window_s)
    columns = [events.schema[c] for c in events.columns if c != "event_time"]

    def step(state, row):
        live = [t for t in (state[0] if state else []) if t > row["ts_us"] - window] + [row["ts_us"]]
        return (live, 0), ([{**row, "n": len(live)}] if len(live) > limit else [])
    return keyed_fold(events, keys, step, _TIMES, window, schema=T.StructType([*columns, T.StructField("n", T.LongType())]))


def threshold_stream(matches: DataFrame, count: int, window_s: float, cooldown_s: float = 60.0, keys=("rule_id", "rule_group")) -> DataFrame:
    """Resetting threshold and cooldown of a rule."""
    window, cooldown = seconds(window_s), seconds(cooldown_s)

    def step(state, row):
        now = row["ts_us"]
        times, last = (list(state[0]), state[1]) if state else ([], -1)
        times = [t for t in times if now - t <= window] + [now]
        if len(times) < count:
            return (times, last), []
        if last >= 0 and now - last < cooldown:
            return ([], last), []
        return ([], now), [row]
    return keyed_fold(matches, list(keys), step, _TIMES, max(window, cooldown))


def hourly_bytes_stream(flows: DataFrame, limit: int = 100_000_000) -> DataFrame:
    """Clock hours in which a pair of hosts moved more than ``limit`` bytes."""
    total = flows.groupBy(F.window("event_time", "1 hour"), "src_ip", "dst_ip").agg(F.sum("bytes").alias("hourly_bytes"))
    return total.where(F.col("hourly_bytes") > limit).select(F.unix_micros("window.start").alias("hour_us"), "src_ip", "dst_ip", "hourly_bytes")


def grid_rate_stream(events: DataFrame, keys: list[str], window: str = "60 seconds", slide: str = "10 seconds", limit: int = 5) -> DataFrame:
    """Counts on a sliding grid: cheaper than :func:`rate_stream`, exact at the grid's edges only."""
    n = events.groupBy(F.window("event_time", window, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > limit).select(F.unix_micros("window.end").alias("until_us"), *keys, "n")


def chain_stream(alerts: DataFrame, gap_s: float = 1800.0) -> DataFrame:
    """Runs of phase-bearing alerts per source; the session gap is exclusive, so one microsecond is added."""
    from fieldtrace.operators.chains import detect_phase
    rows = alerts.withColumn("phase", detect_phase(F.col("anomaly_type"))).where("phase IS NOT NULL")
    gap = f"{seconds(gap_s) + 1} microseconds"
    runs = rows.groupBy(F.session_window("event_time", gap), "src_ip").agg(
        F.count(F.lit(1)).alias("total_events"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.array_sort(F.collect_set("phase")).alias("phases"))
    return runs.where((F.col("total_events") >= 2) & (F.size("phases") >= 2)).drop("session_window")
