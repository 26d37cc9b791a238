"""Sliding counts, expiring duplicates and late rows in streams."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from fieldtrace.operators.sliced import seconds
from fieldtrace.streaming.flows import IdleProcessor


class SlotProcessor(IdleProcessor):
    """Rows of one key with the count of the last ``slots`` time slots; state is one number per live slot."""

    def __init__(self, idle_us: int, columns: list[str], slot_us: int, slots: int, limit: int):
        super().__init__(idle_us, columns)
        self.slot_us, self.slots, self.limit = slot_us, slots, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", "slot long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "seq"], kind="stable")
        own = (frame["ts_us"] // self.slot_us).to_numpy()
        held = sorted((k[0], v[0]) for k, v in self.counts.iterator())
        slots, totals = np.array([k for k, _ in held], np.int64), np.cumsum([0, *(n for _, n in held)])
        # rows of this batch so far within the slots, and those of earlier batches
        n = np.arange(1, len(own) + 1) - np.searchsorted(own, own - self.slots, "right")
        n += totals[np.searchsorted(slots, own, "right")] - totals[np.searchsorted(slots, own - self.slots, "right")]
        last = max(int(own[-1]), int(slots[-1]) if len(slots) else 0)
        for slot in slots[slots <= last - self.slots].tolist():
            self.counts.removeKey((slot,))
        before = dict(held)
        for slot, count in zip(*(x.tolist() for x in np.unique(own[own > last - self.slots], return_counts=True))):
            self.counts.updateValue((slot,), (before.get(slot, 0) + count,))
        self.wait((last + 1) * self.slot_us)
        if (n > self.limit).any():
            yield frame.assign(n=n)[n > self.limit][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        return iter(())


def slot_rate_stream(events: DataFrame, keys: list[str], window_s: float, limit: int, slots: int = 60) -> DataFrame:
    """Rows with more than ``limit`` rows of their key in the last ``slots`` slots, their own included; the slots make up ``window_s``.

    A key holds at most ``slots`` numbers, however many rows it has. Rows with the time of their slot in place of their own have these counts in
    :func:`fieldtrace.operators.sliced.rolling`.
    """
    window = seconds(window_s)
    slot = window // slots
    out = T.StructType([*[events.schema[c] for c in events.columns if c != "event_time"], T.StructField("n", T.LongType())])
    return events.groupBy(*keys).transformWithStateInPandas(SlotProcessor(window, out.names, slot, slots, limit), out, "Append", "EventTime")


class ExpiringProcessor(StatefulProcessor):
    """First alert of each window; an anchor that is not renewed is dropped by the state store itself."""

    def __init__(self, window_us: int, columns: list[str], ttl_ms: int):
        self.window_us, self.columns, self.ttl_ms = window_us, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "ts_us long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "seq"], kind="stable")
        anchor = self.anchor.get()[0] if self.anchor.exists() else None
        first = []
        for ts in frame["ts_us"].tolist():
            first.append(anchor is None or not 0 <= ts - anchor < self.window_us)
            anchor = ts if first[-1] else anchor
        self.anchor.update((anchor,))
        if any(first):
            yield frame[first][self.columns]

    def close(self) -> None:
        pass


def expiring_suppress_stream(alerts: DataFrame, window_s: float = 60.0, keys=("anomaly_type", "src_ip", "dst_ip"), ttl_s: float = 600.0) -> DataFrame:
    """First alert of each window, as :func:`fieldtrace.operators.alerts.suppress_repeats`; a key unseen for ``ttl_s`` is forgotten."""
    out = T.StructType([alerts.schema[c] for c in alerts.columns if c != "event_time"])
    return alerts.groupBy(*keys).transformWithStateInPandas(
        ExpiringProcessor(seconds(window_s), out.names, int(ttl_s * 1000)), out, "Append", "ProcessingTime")


def coarse_suppress_stream(alerts: DataFrame, keys=("anomaly_type", "src_ip", "dst_ip")) -> DataFrame:
    """The first alert of a key within the watermark's delay, by the built-in operator: the window is as coarse as the delay."""
    return alerts.dropDuplicatesWithinWatermark(list(keys))


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of the query's remembered progress dropped as later than the watermark."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


class LateRows(StreamingQueryListener):
    """Counts late rows by query for as long as it is registered (``spark.streams.addListener``).

    Built-in aggregations drop after their partial sums, so there the count is one of groups and not of rows.
    """

    def __init__(self):
        self.counts: Counter = Counter()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            self.counts[event.progress.name or str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
