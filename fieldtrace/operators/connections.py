"""TCP connections: where one ends and the next begins, and byte positions that do not wrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.sliced import running, seconds

DIRECTION = ["capture", "src_ip", "dst_ip", "src_port", "dst_port"]
CONNECTION = [*DIRECTION, "connection_no"]
SYN = 0x02
IDLE_S = 300.0
_WRAP = 1 << 32


def serial_step(after: Column, before: Column) -> Column:
    """Signed distance between two 32-bit sequence numbers, the shorter way round."""
    half = F.lit(_WRAP >> 1)
    return F.pmod(after - before + half, F.lit(_WRAP)) - half


def _with(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, default)


def connections(segments: DataFrame, idle_s: float = IDLE_S) -> DataFrame:
    """Segments with ``connection_no`` (from 1, per direction), ``started_us`` and ``position`` (byte place in the connection).

    A connection begins at a SYN that does not repeat the one before, and after more than
    ``idle_s`` of silence. Positions add up the signed distances between consecutive
    sequence numbers, so they run on over 2^32 and go back for late segments; a SYN takes one place.
    Missing ``capture`` and ``tcp_flags`` count as one capture without flags.
    """
    rows = _with(_with(segments, "capture", F.lit("")), "tcp_flags", F.lit(0)).where(F.col("tcp_seq").isNotNull())
    columns = rows.columns
    syn = F.coalesce(F.col("tcp_flags").bitwiseAND(SYN) != 0, F.lit(False))
    rows = running(rows, DIRECTION, {"_prev": ("prev", F.struct("ts_us", "tcp_seq")), "_syn": ("before", F.when(syn, F.col("tcp_seq")))})
    new = (F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev.ts_us") > seconds(idle_s))
           | (syn & F.coalesce(F.col("_syn") != F.col("tcp_seq"), F.lit(True))))
    rows = rows.withColumns({"_new": new, "_step": F.when(new, 0).otherwise(serial_step(F.col("tcp_seq"), F.col("_prev.tcp_seq"))).cast("long")})
    rows = running(rows, DIRECTION, {"connection_no": ("sum", F.col("_new").cast("long")), "position": ("sum", F.col("_step")),
                                     "started_us": ("last", F.when(F.col("_new"), F.col("ts_us")))})
    return rows.select(*columns, "connection_no", "started_us", (F.col("position") + syn.cast("long")).alias("position"))
