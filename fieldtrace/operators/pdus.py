"""Protocol messages out of TCP segments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.dissect import route_by_port
from fieldtrace.operators.sliced import running, seconds
from fieldtrace.session import width as parallel

FLOW = ["capture", "src_ip", "dst_ip", "src_port", "dst_port"]
SYN, FIN, RST = 0x02, 0x01, 0x04


@dataclass(frozen=True)
class Header:
    """Where the header of a protocol's messages says how long they are.

    ``fixed``: bytes at the front or elsewhere that every message has; ``field``: offset, width and byte order of the
    length; ``beyond``: bytes the length does not count; ``legal``: smallest and largest length.
    """
    size: int
    field: tuple[int, int, str] | None
    beyond: int = 0
    fixed: tuple[tuple[int, bytes], ...] = ()
    legal: tuple[int, int] = (0, 1 << 32)
    capitals: int = 0           # leading bytes that are capital letters
    block: int = 0              # data bytes per check sum of two bytes; the length counts the smallest legal header


# fixed values: the layouts of the protocols
HEADERS = {
    "MODBUS_TCP": Header(7, (4, 2, "big"), beyond=6, fixed=((2, b"\0\0"),), legal=(2, 254)),
    "S7COMM": Header(4, (2, 2, "big"), fixed=((0, b"\x03\0"),), legal=(7, 65535)),
    "DNP3": Header(3, (2, 1, "big"), beyond=5, fixed=((0, b"\x05\x64"),), legal=(5, 255), block=16),
    "ENIP": Header(24, (2, 2, "little"), beyond=24),
    "IEC_104": Header(2, (1, 1, "big"), beyond=2, fixed=((0, b"\x68"),), legal=(4, 255)),
    "OPC_UA": Header(8, (4, 4, "little"), legal=(8, 1 << 24), capitals=3),
    "MQTT": Header(2, None),    # a length of one to four bytes, seven bits each
}


def message_size(data: bytes, at: int, protocol: str) -> int | None:
    """Bytes of the message at ``at``; 0 while its header is incomplete, None if no message begins there."""
    header = HEADERS[protocol]
    if len(data) - at < header.size:
        return 0
    if header.field is None:
        return _varint_size(data, at)
    if any(data[at + k:at + k + len(mark)] != mark for k, mark in header.fixed):
        return None
    first = data[at:at + header.capitals]
    if not all(65 <= x <= 90 for x in first):
        return None
    offset, width, order = header.field
    length = int.from_bytes(data[at + offset:at + offset + width], order)
    if not header.legal[0] <= length <= header.legal[1]:
        return None
    sums = -(-(length - header.legal[0]) // header.block) * 2 if header.block else 0
    return length + header.beyond + sums


def _varint_size(data: bytes, at: int) -> int | None:
    if data[at] < 16:           # packet type 0 does not exist
        return None
    tail = data[at + 1:at + 5]
    last = next((k for k, x in enumerate(tail) if x < 128), None)
    if last is None:
        return None if len(tail) == 4 else 0
    return 2 + last + sum((x & 127) << 7 * k for k, x in enumerate(tail[:last + 1]))


class Unfinished:
    """The unfinished message of a gapless run; bytes are joined only when a message may be complete."""

    def __init__(self, protocol: str, held: bytes = b"", most: int | None = None):
        self.protocol, self.most = protocol, most
        self.parts, self.have, self.need = [held] if held else [], len(held), 0

    def push(self, payload: bytes) -> list[bytes]:
        """The messages that ``payload`` completes; bytes that are no message pass through as they are."""
        self.parts.append(payload)
        self.have += len(payload)
        if self.have < self.need and not (self.most and self.have > self.most):
            return []
        data, at, out, self.need = b"".join(self.parts), 0, [], 0
        while at < len(data):
            size, left = message_size(data, at, self.protocol), len(data) - at
            if size is None or (self.most and left > self.most and not 0 < size <= left):
                out.append(data[at:])
                at = len(data)
            elif size == 0 or size > left:
                self.need = max(size, left + 1)
                break
            else:
                out.append(data[at:at + size])
                at += size
        self.parts, self.have = [data[at:]] if at < len(data) else [], len(data) - at
        return out

    def close(self) -> list[bytes]:
        """What is left, as it is."""
        left, self.parts, self.have, self.need = b"".join(self.parts), [], 0, 0
        return [left] if left else []


def cut(buffer: bytes, protocol: str) -> tuple[list[bytes], bytes]:
    """Complete messages at the front of a buffer and what remains."""
    run = Unfinished(protocol)
    messages = run.push(buffer) if buffer else []
    return messages, b"".join(run.parts)


_PDU = pa.schema([("capture", pa.string()), ("src_ip", pa.string()), ("dst_ip", pa.string()), ("src_port", pa.int32()), ("dst_port", pa.int32()),
                  ("protocol", pa.string()), ("ts_us", pa.int64()), ("seq", pa.int64()), ("pdu_no", pa.int32()), ("payload", pa.binary())])
_DDL = ("capture string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ts_us long, seq long, "
        "pdu_no int, payload binary")


def _framed(most: int | None):
    """Streams the sorted segments; holds the unfinished message of one run and nothing else."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_run, meta = None, None, None
        for batch in batches:
            rows = []
            *where, protocol, ts, seq, ends, payload = (c.to_pylist() for c in batch.columns)
            for i, here in enumerate(zip(*where)):
                if here != key:
                    if open_run:
                        rows += [(*meta, n, m) for n, m in enumerate(open_run.close())]
                    key, open_run = here, Unfinished(protocol[i], most=most)
                meta = (*here[:-1], protocol[i], ts[i], seq[i])
                messages = open_run.push(payload[i]) if payload[i] else []
                messages += open_run.close() if ends[i] else []
                rows += [(*meta, n, m) for n, m in enumerate(messages)]
            if rows:
                yield _batch(rows)
        if open_run and (left := open_run.close()):
            yield _batch([(*meta, 0, left[0])])
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PDU)], schema=_PDU)


def stream_runs(segments: DataFrame, idle_s: float | None = None) -> DataFrame:
    """Number the contiguous runs of each direction of a connection.

    Nothing carries over a SYN, a FIN or RST, a gap in the sequence numbers, or more than
    ``idle_s`` of silence if given, so runs are independent. An exact repeat of the previous
    segment keeps its flags but loses its payload.
    """
    flags = F.col("tcp_flags")
    rows = segments.where(F.col("tcp_seq").isNotNull()).select(
        *FLOW, "protocol", "ts_us", "seq", "tcp_seq", (flags.bitwiseAND(SYN) != 0).alias("begins"),
        (flags.bitwiseAND(FIN | RST) != 0).alias("ends"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    some = F.octet_length("payload") > 0
    rows = running(rows, FLOW, {"_prev": ("before", F.when(some & ~F.col("begins"), F.struct("tcp_seq", "payload"))), "_ended": ("prev", F.col("ends")),
                                "_quiet": ("prev", F.col("ts_us"))})
    again = F.coalesce(some & (F.col("_prev.tcp_seq") == F.col("tcp_seq")) & (F.col("_prev.payload") == F.col("payload")), F.lit(False))
    gap = some & ~again & F.col("_prev").isNotNull() & (
        F.col("tcp_seq") != F.pmod(F.col("_prev.tcp_seq") + F.octet_length("_prev.payload"), F.lit(1 << 32)))
    idle = F.lit(False) if idle_s is None else F.coalesce(F.col("ts_us") - F.col("_quiet") > seconds(idle_s), F.lit(False))
    rows = rows.withColumn("_break", (F.col("begins") | F.coalesce("_ended", F.lit(False)) | gap | idle).cast("long"))
    rows = rows.withColumn("payload", F.when(again | F.col("begins"), F.lit(b"")).otherwise(F.col("payload"))).drop("_prev", "_ended", "_quiet")
    return running(rows, FLOW, {"run": ("sum", F.col("_break"))}).drop("_break", "begins", "tcp_seq")


def reassemble_ot_pdus(segments: DataFrame, idle_s: float | None = None, max_buffer: int | None = None) -> DataFrame:
    """Messages of industrial TCP connections; UDP datagrams are messages as they are.

    With ``max_buffer``, more bytes than that without a whole message are passed on as they are.
    """
    routed = route_by_port(segments).where("protocol IS NOT NULL")
    tcp = stream_runs(routed.where(F.col("ip_proto") == 6), idle_s)
    cols = [*FLOW, "run", "protocol", "ts_us", "seq", "ends", "payload"]
    pdus = (tcp.select(*cols).repartition(parallel(tcp), *FLOW, "run").sortWithinPartitions(*FLOW, "run", "ts_us", "seq").mapInArrow(_framed(max_buffer), _DDL))
    udp = routed.where((F.col("ip_proto") == 17) & (F.octet_length("payload") > 0)).select(
        *FLOW, "protocol", "ts_us", "seq", F.lit(0).alias("pdu_no"), "payload")
    return pdus.unionByName(udp)
