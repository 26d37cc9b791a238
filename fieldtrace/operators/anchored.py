"""Mark chains: greedy windows, cooldowns and resetting thresholds without one task per key.

A mark is a row at which state restarts: the first row further than ``gap`` from
the previous mark (greedy windows, cooldowns), or the row that completes ``count``
matches within ``window`` since the previous mark (resetting threshold). The next
mark is a monotone function of the previous one that looks back a bounded time,
so each (key, slice) can be summarised as a small table "if the last mark on
entry is p, the last mark on exit is q". The tables are folded along each key,
which gives every slice its entry state, and the slices then emit their marks
independently. Rows stream through sorted partitions; only the timestamps of one
slice are held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.operators.sliced import MINUTE, slice_of, spread
from fieldtrace.session import width as parallel

OLDER = -(2 ** 62)

# (key, ts, first own row) -> successor of "no mark in view" and of each row, len(ts) meaning none
Successor = Callable[[str, np.ndarray, int], np.ndarray]
SEP = "\u0001"


def _of(setting, key: str):
    """A constant, or the value for the first part of the key."""
    return setting[key.split(SEP, 1)[0]] if isinstance(setting, dict) else setting


def gap_successor(gap_us: int | dict[str, int], strict: bool) -> Successor:
    """Next mark: first row more than (``strict``) or at least ``gap_us`` after the last."""
    def successor(key: str, ts: np.ndarray, head: int) -> np.ndarray:
        nxt = np.searchsorted(ts, ts + _of(gap_us, key), side="right" if strict else "left")
        nxt = np.maximum(np.maximum(nxt, np.arange(1, len(ts) + 1)), head)
        return np.concatenate(([head], nxt))
    return successor


def threshold_successor(limits: tuple[int, int] | dict[str, tuple[int, int]]) -> Successor:
    """Next mark: first row closing ``count`` rows within ``window_us`` since the last mark."""
    def successor(key: str, ts: np.ndarray, head: int) -> np.ndarray:
        count, window_us = _of(limits, key)
        size = len(ts)
        hits = np.arange(count - 1, size)
        hits = hits[(ts[hits] - ts[hits - count + 1] <= window_us) & (hits >= head)] if size >= count else hits[:0]
        wanted = np.arange(-1, size) + count
        return np.append(hits, size)[np.searchsorted(hits, wanted)]
    return successor


def groups(batches: Iterator[pa.RecordBatch], by: list[str]):
    """Yield (key, columns) per run of equal ``by`` columns; runs may cross batches."""
    current, parts = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for name in by:
            change |= cols[name][1:] != cols[name][:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(cols[n][lo] for n in by)
            part = {n: c[lo:hi] for n, c in cols.items()}
            if key != current:
                if parts:
                    yield current, {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
                current, parts = key, []
            parts.append(part)
    if parts:
        yield current, {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pending = []
    for row in rows:
        pending.append(row)
        if len(pending) >= 8192:
            yield _emit(pending, schema)
            pending = []
    if pending:
        yield _emit(pending, schema)


_TABLE = pa.schema([("_k", pa.string()), ("_slice", pa.int64()), ("c_ts", pa.int64()), ("c_seq", pa.int64()),
                    ("f_ts", pa.int64()), ("f_seq", pa.int64()), ("moved", pa.bool_())])
_STATE = pa.schema([("_k", pa.string()), ("_slice", pa.int64()), ("kind", pa.int32()),
                    ("ts", pa.int64()), ("seq", pa.int64())])
_MARK = pa.schema([("_k", pa.string()), ("_slice", pa.int64()), ("ts", pa.int64()), ("seq", pa.int64()),
                   ("carry", pa.bool_())])
_DDL = {
    "table": "_k string, _slice long, c_ts long, c_seq long, f_ts long, f_seq long, moved boolean",
    "state": "_k string, _slice long, kind int, ts long, seq long",
    "mark": "_k string, _slice long, ts long, seq long, carry boolean",
}


def _transfer(successor: Successor):
    def rows(batches):
        for (k, s), c in groups(batches, ["_k", "_slice"]):
            ts, seq = c["ts"], c["seq"]
            head = int((c["kind"] == 1).sum())
            size = len(ts)
            if head == size:
                continue
            nxt = successor(k, ts, head)
            last = np.where(nxt[1:] < size, nxt[1:], np.arange(size))
            while True:
                further = last[last]
                if np.array_equal(further, last):
                    break
                last = further
            entry = nxt[: head + 1]
            final = np.where(entry < size, last[np.minimum(entry, size - 1)], -1)
            keep = np.concatenate(([True], final[1:] != final[:-1]))
            for p in np.flatnonzero(keep):
                q = int(final[p])
                yield (k, int(s), OLDER if p == 0 else int(ts[p - 1]), 0 if p == 0 else int(seq[p - 1]),
                       int(ts[q]) if q >= 0 else 0, int(seq[q]) if q >= 0 else 0, q >= 0)
    return lambda batches: batched(rows(batches), _TABLE)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        key, state = None, None
        for (k, s), c in groups(batches, ["_k", "_slice"]):
            if k != key:
                key, state = k, None
            if state is not None:
                yield (k, int(s), 0, state[0], state[1])
            at = 0
            if state is not None:
                at = int(np.searchsorted(c["c_ts"], state[0], side="right")) - 1
                while at > 0 and (c["c_ts"][at], c["c_seq"][at]) > state:
                    at -= 1
            if c["moved"][at]:
                state = (int(c["f_ts"][at]), int(c["f_seq"][at]))
    return batched(rows(), _STATE)


def _marks(successor: Successor):
    def rows(batches):
        for (k, s), c in groups(batches, ["_k", "_slice"]):
            kind = c["kind"]
            carried = bool(kind[0] == 0)
            ts, seq = c["ts"][carried:], c["seq"][carried:]
            head = int((kind == 1).sum())
            size = len(ts)
            if head == size:
                continue
            nxt = successor(k, ts, head)
            p = -1
            if carried:
                state = (c["ts"][0], c["seq"][0])
                yield (k, int(s), int(state[0]), int(state[1]), True)
                at = int(np.searchsorted(ts[:head], state[0], side="left"))
                while at < head and (ts[at], seq[at]) < state:
                    at += 1
                if at < head and (ts[at], seq[at]) == state:
                    p = at
            j = int(nxt[p + 1])
            while j < size:
                yield (k, int(s), int(ts[j]), int(seq[j]), False)
                j = int(nxt[j + 1])
    return lambda batches: batched(rows(batches), _MARK)


def _with_marks(df: DataFrame, keys: list[str], lookback_us: int, successor: Successor, ts: str, seq: str,
                width: int | None) -> DataFrame:
    df = df.drop("mark_us", "mark_seq", "is_mark")
    width = width or max(4 * lookback_us, 10 * MINUTE)
    tasks = parallel(df)
    text = F.concat_ws(SEP, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    rows = df.withColumn("_k", text)
    points = (spread(rows.select("_k", F.col(ts).alias("ts"), F.col(seq).cast("long").alias("seq")),
                     "ts", lookback_us, width)
              .select("_k", "_slice", F.when(F.col("_slice") == F.col("_own"), 2).otherwise(1).alias("kind"),
                      "ts", "seq"))
    tables = (points.repartition(tasks, "_k", "_slice").sortWithinPartitions("_k", "_slice", "kind", "ts", "seq")
              .mapInArrow(_transfer(successor), _DDL["table"]))
    states = (tables.repartition(tasks, "_k").sortWithinPartitions("_k", "_slice", "c_ts", "c_seq")
              .mapInArrow(_fold, _DDL["state"]))
    marks = (points.unionByName(states).repartition(tasks, "_k", "_slice")
             .sortWithinPartitions("_k", "_slice", "kind", "ts", "seq")
             .mapInArrow(_marks(successor), _DDL["mark"]))
    tagged = rows.withColumn("_slice", slice_of(F.col(ts), width)).select(
        "_k", "_slice", F.col(ts).alias("_ts"), F.col(seq).cast("long").alias("_seq"), F.lit(1).alias("_tag"),
        F.struct(*df.columns).alias("_row"))
    signs = marks.select("_k", "_slice", F.col("ts").alias("_ts"), F.col("seq").alias("_seq"),
                         F.lit(0).alias("_tag"), F.lit(None).cast(df.schema).alias("_row"))
    w = (Window.partitionBy("_k", "_slice").orderBy("_ts", "_seq", "_tag")
         .rowsBetween(Window.unboundedPreceding, 0))
    mark = F.last(F.when(F.col("_tag") == 0, F.struct("_ts", "_seq")), ignorenulls=True).over(w)
    return (tagged.unionByName(signs).withColumn("_mark", mark).where("_tag = 1")
            .select("_row.*", F.col("_mark._ts").alias("mark_us"), F.col("_mark._seq").alias("mark_seq"),
                    F.coalesce((F.col("_mark._ts") == F.col("_ts")) & (F.col("_mark._seq") == F.col("_seq")),
                               F.lit(False)).alias("is_mark")))


def anchored(df: DataFrame, keys: list[str], gap_us: int, *, strict: bool = True, ts: str = "ts_us",
             seq: str = "seq", width: int | None = None) -> DataFrame:
    """Greedy windows anchored at the first row of a key and reopened past ``gap_us``.

    Adds ``mark_us``/``mark_seq`` (the row that opened the window) and ``is_mark``.
    ``strict`` reopens at a distance above the gap, otherwise at the gap itself.
    """
    return _with_marks(df, keys, gap_us, gap_successor(gap_us, strict), ts, seq, width)


def cooled(df: DataFrame, keys: list[str], cooldown_us: int | dict[str, int], **order) -> DataFrame:
    """Keep a row only when the cooldown passed since the last kept row of its key.

    A dict gives the cooldown by the value of the first key column.
    """
    longest = max(cooldown_us.values(), default=0) if isinstance(cooldown_us, dict) else cooldown_us
    if longest <= 0:
        return df
    ts, seq = order.get("ts", "ts_us"), order.get("seq", "seq")
    return (_with_marks(df, keys, longest, gap_successor(cooldown_us, False), ts, seq, order.get("width"))
            .where("is_mark").drop("mark_us", "mark_seq", "is_mark"))


def tripped(df: DataFrame, keys: list[str], limits: tuple[int, int] | dict[str, tuple[int, int]], *, ts: str = "ts_us",
            seq: str = "seq", width: int | None = None) -> DataFrame:
    """Rows completing ``count`` rows within ``window_us`` (closed), counting afresh after each.

    ``limits`` is (count, window_us), or a dict of them by the value of the first key column.
    """
    longest = max(w for _, w in limits.values()) if isinstance(limits, dict) else limits[1]
    return (_with_marks(df, keys, longest, threshold_successor(limits), ts, seq, width)
            .where("is_mark").drop("mark_us", "mark_seq", "is_mark"))
