"""Connections in streams: industrial messages and HTTP messages, with the unfinished part as state.

State is kept per direction of a connection and capture. An event-time timer fires after ``idle_s`` of silence, emits what
is unfinished and clears the state, so nothing is lost and nothing stays. Rows of a
micro-batch are taken in order of time; the results equal the batch operators of
``operators.pdus`` and ``operators.http`` with the same ``idle_s``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldtrace.operators.connections import DIRECTION, IDLE_S, SYN
from fieldtrace.operators.http import START
from fieldtrace.operators.pdus import FIN, RST, Unfinished
from fieldtrace.operators.sliced import seconds

_WRAP = 1 << 32
_KEY = [T.StructField(c, T.IntegerType() if c.endswith("port") else T.StringType()) for c in DIRECTION]


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """The rows of a micro-batch by time."""
    rows = pd.concat(list(frames)).sort_values(["ts_us", "seq"], kind="stable")
    return list(zip(*(rows[c].tolist() for c in columns)))


class IdleProcessor(StatefulProcessor):
    """A processor with one timer, ``idle_us`` after the last row of its key."""

    def __init__(self, idle_us: int, columns: list[str]):
        self.idle_us, self.columns = idle_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait(self, last_us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # the first millisecond that is later than the silence allowed
        self.handle.registerTimer((last_us + self.idle_us) // 1000 + 1)

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.columns)

    def close(self) -> None:
        pass


_PDU_OUT = T.StructType([*_KEY, T.StructField("protocol", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType()),
                         T.StructField("pdu_no", T.IntegerType()), T.StructField("payload", T.BinaryType())])


class PduProcessor(IdleProcessor):
    """Messages of one direction. State: what the last segment was, and the parts of the unfinished message."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "protocol string, ts_us long, seq long, ended boolean, data_seq long, data binary")
        self.parts = handle.getListState("parts", "part binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, run, made = None, None, []
        if self.now.exists():
            last = self.now.get()
            run = Unfinished(last[0], b"".join(p[0] for p in self.parts.get()))
        for protocol, ts, seq, at, flags, payload in in_order(rows, ["protocol", "ts_us", "seq", "tcp_seq", "tcp_flags", "payload"]):
            payload, begins = payload or b"", bool(int(flags) & SYN)
            idle = last is not None and ts - last[1] > self.idle_us
            before = (None, b"") if last is None or idle or last[4] is None else (last[4], bytes(last[5]))
            again = bool(payload) and before == (at, payload)
            gap = bool(payload) and not again and before[0] is not None and at != (before[0] + len(before[1])) % _WRAP
            if last is None or begins or last[3] or gap or idle:
                made += [(*last[:3], n, m) for n, m in enumerate(run.close())] if run else []
                run = Unfinished(protocol)
            ends = bool(int(flags) & (FIN | RST))
            messages = run.push(payload) if payload and not again and not begins else []
            messages += run.close() if ends else []
            made += [(protocol, ts, seq, n, m) for n, m in enumerate(messages)]
            data = (at, payload) if payload and not begins else before
            last = (protocol, ts, seq, ends, data[0], data[1])
        self.now.update(last)
        self.parts.clear()
        if run.parts:
            self.parts.put([(p,) for p in run.parts])
        self.wait(last[1])
        if made:
            yield self.frame(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, left = self.now.get(), b"".join(p[0] for p in self.parts.get())
        self.now.clear()
        self.parts.clear()
        if left:
            yield self.frame(key, [(*last[:3], 0, left)])


def pdu_stream(segments: DataFrame, idle_s: float = IDLE_S) -> DataFrame:
    """Messages of industrial TCP streams as :func:`fieldtrace.operators.pdus.reassemble_ot_pdus` with ``idle_s``."""
    return segments.groupBy(*DIRECTION).transformWithStateInPandas(
        PduProcessor(seconds(idle_s), _PDU_OUT.names), _PDU_OUT, "Append", "EventTime")


_MESSAGE_OUT = T.StructType([*_KEY, *[T.StructField(c, T.LongType()) for c in ("started_us", "message_no", "ts_us", "last_us", "seq", "chunks")],
                             T.StructField("data", T.BinaryType())])
_STARTS = re.compile(START.encode())


class HttpProcessor(IdleProcessor):
    """Messages of one direction. State: where the connection stands, the chunks of the open message, and segments that came early."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "started_us long, last_us long, raw long, place long, syn long, first long, reach long, message_no long")
        self.open = handle.getListState("open", "ts_us long, seq long, chunk binary")
        self.early = handle.getListState("early", "position long, ts_us long, seq long, payload binary")

    # the state of one call, written back at its end
    def _load(self) -> None:
        self.s = dict(zip(("started", "last", "raw", "place", "syn", "first", "reach", "no"), self.now.get())) if self.now.exists() else None
        self.chunks: list[tuple] = []
        self.waiting = {r[0]: (r[1], r[2], bytes(r[3])) for r in self.early.get()} if self.s else {}
        self.were = set(self.waiting)
        self.made: list[tuple] = []

    def _message(self) -> None:
        chunks = [*((r[0], r[1], bytes(r[2])) for r in self.open.get()), *self.chunks]
        if chunks:
            self.made.append((self.s["started"], self.s["no"], min(c[0] for c in chunks), max(c[0] for c in chunks), min(c[1] for c in chunks),
                              len(chunks), b"".join(c[2] for c in chunks)))
        self.open.clear()
        self.chunks = []

    def _take(self, position: int, ts: int, seq: int, payload: bytes) -> None:
        chunk = payload[max(0, self.s["reach"] - position):]
        if not chunk:
            return
        self.s["reach"] = position + len(payload)
        if _STARTS.match(chunk):
            self._message()
            self.s["no"] += 1
        self.chunks.append((ts, seq, chunk))

    def _drain(self) -> None:
        """Early segments that have become due."""
        for position in sorted(p for p in self.waiting if p >= self.s["first"]):
            if position > self.s["reach"]:
                break
            self._take(position, *self.waiting.pop(position))

    def _flush(self) -> None:
        """The connection is over: what came early follows over the gaps; bytes from before the first segment are a message of their own."""
        before = sorted(p for p in self.waiting if p < self.s["first"])
        lead = {p: self.waiting.pop(p) for p in before}
        for position in sorted(self.waiting):
            self._take(position, *self.waiting.pop(position))
        self._message()
        if lead:
            self.s |= {"no": -1, "reach": before[0]}
            for position in before:
                self._take(position, *lead[position])
            self._message()

    def _row(self, ts: int, seq: int, raw: int, flags: int, payload: bytes) -> None:
        syn, s = bool(flags & SYN), self.s
        if s is None or ts - s["last"] > self.idle_us or (syn and s["syn"] != raw):
            if s is not None:
                self._flush()
            self.s = s = {"started": ts, "last": ts, "raw": raw, "place": 0, "syn": s["syn"] if s and not syn else None, "first": None, "reach": 0, "no": 0}
        s["place"] += (raw - s["raw"] + _WRAP // 2) % _WRAP - _WRAP // 2
        s["raw"], s["last"] = raw, ts
        position = s["place"] + syn
        if syn:
            s["syn"] = raw
            if s["first"] is None:
                s["first"] = s["reach"] = position
        if not payload:
            return
        if s["first"] is None:
            s["first"] = s["reach"] = position
        if position < s["first"] or position > s["reach"]:
            self.waiting.setdefault(position, (ts, seq, payload))
        else:
            self._take(position, ts, seq, payload)
            self._drain()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for ts, seq, raw, flags, payload in in_order(rows, ["ts_us", "seq", "tcp_seq", "tcp_flags", "payload"]):
            self._row(ts, seq, int(raw), int(flags), bytes(payload or b""))
        s = self.s
        self.now.update((s["started"], s["last"], s["raw"], s["place"], s["syn"], s["first"], s["reach"], s["no"]))
        if self.chunks:
            self.open.appendList(self.chunks)
        if set(self.waiting) != self.were:
            self.early.clear()
            if self.waiting:
                self.early.put([(p, *v) for p, v in sorted(self.waiting.items())])
        self.wait(s["last"])
        if self.made:
            yield self.frame(key, self.made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        if self.s is not None:
            self._flush()
        self.now.clear()
        self.open.clear()
        self.early.clear()
        if self.made:
            yield self.frame(key, self.made)


def http_message_stream(segments: DataFrame, idle_s: float = IDLE_S) -> DataFrame:
    """Messages of web connections as :func:`fieldtrace.operators.http.reassemble_http`, each emitted when the next one begins, or
    when the connection ends or has been silent for ``idle_s``. Where a late segment overlaps bytes that are already taken, the taken ones stay."""
    return segments.groupBy(*DIRECTION).transformWithStateInPandas(
        HttpProcessor(seconds(idle_s), _MESSAGE_OUT.names), _MESSAGE_OUT, "Append", "EventTime")
