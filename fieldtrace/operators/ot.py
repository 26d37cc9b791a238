"""Detectors over decoded industrial-protocol events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.operators.anchored import batched, groups
from fieldtrace.operators.shaping import alert
from fieldtrace.operators.sliced import numbered, rolling, running, seconds, spread
from fieldtrace.session import width as parallel

WRITES = ["WRITE", "CONTROL"]


def is_write(column: str = "operation_type"):
    return F.col(column).isin(WRITES)


def rapid_write_sequence(events: DataFrame, last: int = 10, writes: int = 7, span_s: float = 5.0) -> DataFrame:
    """Most of the last few commands between two hosts are writes, within seconds."""
    span, keys = seconds(span_s), ["src_ip", "dst_ip"]
    ranked = numbered(events.select("ts_us", "seq", "protocol", "operation_type", *keys), keys)
    rows = spread(ranked, "ts_us", span, 20 * span)
    frame = Window.partitionBy(*keys, "_slice").orderBy("ts_us", "seq").rowsBetween(-(last - 1), 0)
    rows = (rows.withColumn("write_count", F.sum(is_write().cast("long")).over(frame))
                .withColumn("span_us", F.col("ts_us") - F.min("ts_us").over(frame))
                .withColumn("_seen", F.count(F.lit(1)).over(frame)))
    # a frame cut by the slice reaches back further than the span, so it cannot fire
    fired = rows.where((F.col("_slice") == F.col("_own")) & (F.col("_seen") == F.least(F.col("rn"), F.lit(last)))
                       & (F.col("rn") >= 3) & (F.col("write_count") >= writes) & (F.col("span_us") < span))
    return alert(fired, "RAPID_WRITE_SEQUENCE", "HIGH", confidence=0.85, mitre=["T0831", "T0833"],
                 evidence={"write_count": F.col("write_count"), "span_us": F.col("span_us")})


def abnormal_write_rate(events: DataFrame, warmup: int = 100, windows: int = 40, window_s: float = 60.0,
                        sigmas: float = 3.0, min_recent: int = 30) -> DataFrame:
    """Write rate above what the first writes of the same conversation looked like."""
    window, keys = seconds(window_s), ["src_ip", "dst_ip", "protocol"]
    writes = events.where(is_write()).select("ts_us", "seq", *keys)
    ranked = numbered(rolling(writes, keys, window, {"recent": ("count", None)}), keys)
    early = ranked.where(F.col("rn") <= warmup)     # at most `warmup` rows per key
    ahead = Window.partitionBy(*keys).orderBy("ts_us").rangeBetween(0, window)
    counts = early.withColumn("ahead", F.max("rn").over(ahead) - F.col("rn") + 1)
    normal = (counts.groupBy(*keys).agg(
        F.max("rn").alias("learned"),
        F.avg(F.when(F.col("rn") <= windows, F.col("ahead"))).alias("mean"),
        F.stddev_pop(F.when(F.col("rn") <= windows, F.col("ahead"))).alias("std"))
        .where(F.col("learned") >= warmup))
    fired = ranked.join(normal, keys).where(
        (F.col("rn") >= warmup) & (F.col("recent") > F.col("mean") + sigmas * F.col("std"))
        & (F.col("recent") > min_recent))
    return alert(fired, "ABNORMAL_WRITE_RATE", "HIGH", confidence=0.80, mitre=["T0831", "T0806"],
                 evidence={"current_rate": F.col("recent"), "baseline_mean": F.col("mean")})


def high_entropy_payload(events: DataFrame, min_entropy: float = 7.5, min_bytes: int = 20) -> DataFrame:
    fired = events.where((F.col("payload_entropy") > min_entropy) & (F.octet_length("raw") > min_bytes))
    return alert(fired, "HIGH_ENTROPY_PAYLOAD", "MEDIUM", confidence=0.60, mitre=["T0820", "T0851"],
                 evidence={"entropy": F.col("payload_entropy"), "payload_size": F.octet_length("raw")})


_REPLAY = pa.schema([("ts_us", pa.int64()), ("seq", pa.int64()), ("src_ip", pa.string()), ("src_port", pa.int32()),
                     ("dst_ip", pa.string()), ("protocol", pa.string()), ("original_us", pa.int64()),
                     ("original_source", pa.string())])


def _copies_from_elsewhere(window: int):
    """Per identical command: the oldest copy in the window that another connection sent."""
    def rows(batches):
        for _, c in groups(batches, ["_k", "_slice"]):
            ts, flow, size = c["ts_us"], c["flow"], len(c["ts_us"])
            if size < 2:
                continue
            oldest = np.searchsorted(ts, ts - window, side="right")
            turns = np.append(np.flatnonzero(flow[1:] != flow[:-1]) + 1, size)
            turn = turns[np.searchsorted(turns, oldest, side="right")]
            original = np.where(flow[oldest] != flow, oldest, turn)
            for i in np.flatnonzero((original < np.arange(size)) & c["_mine"].astype(bool)):
                j = original[i]
                yield (int(ts[i]), int(c["seq"][i]), c["src_ip"][i], int(c["src_port"][i]), c["dst_ip"][i],
                       c["protocol"][i], int(ts[j]), flow[j])
    return lambda batches: batched(rows(batches), _REPLAY)


def ot_replay(events: DataFrame, window_s: float = 300.0, min_bytes: int = 10) -> DataFrame:
    """A state-changing command seen again, byte for byte, from another connection."""
    window = seconds(window_s)
    rows = events.where(F.col("operation_type").isin("WRITE", "CONTROL", "CONFIG")
                        & (F.octet_length("raw") > min_bytes))
    rows = rows.select("ts_us", "seq", "src_ip", F.col("src_port").cast("int").alias("src_port"), "dst_ip", "protocol",
                       F.concat_ws(":", "src_ip", "src_port").alias("flow"),
                       F.concat_ws("\u0001", "protocol", "dst_ip", F.sha2("raw", 256)).alias("_k"))
    copies = (spread(rows, "ts_us", window, 4 * window)
              .withColumn("_mine", (F.col("_slice") == F.col("_own")).cast("int")).drop("_own"))
    found = (copies.repartition(parallel(copies), "_k", "_slice").sortWithinPartitions("_k", "_slice", "ts_us", "seq")
             .mapInArrow(_copies_from_elsewhere(window),
                         "ts_us long, seq long, src_ip string, src_port int, dst_ip string, protocol string, "
                         "original_us long, original_source string"))
    return alert(found, "OT_REPLAY_ATTACK", "CRITICAL", confidence=0.75, mitre=["T0830", "T0855", "T0856"],
                 evidence={"original_us": F.col("original_us"), "original_source": F.col("original_source"),
                           "src_port": F.col("src_port")})


def firmware_manipulation(events: DataFrame) -> DataFrame:
    """Download and firmware commands of each protocol."""
    proto, fc, name = F.col("protocol"), F.col("function_code"), F.col("function_name")
    indicators = F.array_compact(F.array(
        F.when((proto == "S7COMM") & fc.isin(0x1A, 0x1B, 0x1C), "S7_DOWNLOAD_SEQUENCE"),
        F.when((proto == "S7COMM") & name.contains("Download"), "S7_FIRMWARE_DOWNLOAD"),
        F.when((proto == "MODBUS_TCP") & (fc == 90), "MODBUS_FIRMWARE_UPDATE"),
        F.when((proto == "MODBUS_TCP") & (fc == 43), "MODBUS_MEI_RECON"),
        F.when((proto == "ENIP") & (fc == 0x52), "CIP_MULTI_SERVICE"),
        F.when((proto == "OPC_UA") & name.contains("WriteRequest"), "OPCUA_POTENTIAL_FIRMWARE")))
    fired = events.withColumn("_found", indicators).where(F.size("_found") > 0)
    return alert(fired, "OT_FIRMWARE_MANIPULATION", "CRITICAL", confidence=0.90, mitre=["T0839", "T0857", "T0843"],
                 evidence={"indicators": F.array_join("_found", ","), "function": F.col("function_name")})


def setpoint_manipulation(events: DataFrame, window_s: float = 60.0, min_writes: int = 10,
                          address_ratio: float = 0.5) -> DataFrame:
    """Many writes to few addresses of one device within a minute."""
    writes = events.where(is_write() & (F.col("protocol") != "MQTT")).select(
        "ts_us", "seq", "src_ip", "dst_ip", "protocol", "data_address")
    rows = rolling(writes, ["dst_ip", "protocol"], seconds(window_s),
                   {"write_count": ("count", None), "addresses": ("distinct", F.col("data_address"))})
    fired = rows.where((F.col("write_count") > min_writes)
                       & (F.col("addresses") < F.col("write_count") * address_ratio))
    return alert(fired, "OT_SETPOINT_MANIPULATION", "HIGH", confidence=0.80, mitre=["T0831", "T0836", "T0833"],
                 evidence={"write_count": F.col("write_count"), "unique_addresses": F.col("addresses")})


def protocol_state_violation(events: DataFrame) -> DataFrame:
    """Commands sent before the session or selection the protocol asks for."""
    proto, fc, name = F.col("protocol"), F.col("function_code"), F.col("function_name")
    uframe = F.coalesce(F.col("notes"), F.lit("")).contains("U-Frame")
    opened = F.when(((proto == "S7COMM") & ((fc == 0xF0) | ~is_write()))
                    | ((proto == "IEC_104") & uframe & name.contains("STARTDT")), F.lit(1))
    rows = (events.where(proto.isin("S7COMM", "IEC_104", "DNP3"))
            .select("ts_us", "seq", "src_ip", "dst_ip", "protocol", "function_code", "function_name",
                    "operation_type", "notes"))
    rows = running(rows, ["src_ip", "dst_ip", "protocol"],
                   {"_open": ("before", opened), "_last_fc": ("prev", fc)})
    idle = F.col("_open").isNull()
    violation = (
        F.when((proto == "S7COMM") & idle & ~fc.isin(0xF0, 0x00) & is_write(), "S7_WRITE_WITHOUT_SETUP")
        .when((proto == "IEC_104") & idle & uframe & ~name.contains("STARTDT") & name.contains("STOPDT"),
              "IEC104_STOP_WITHOUT_START")
        .when((proto == "IEC_104") & idle & ~uframe & (F.col("operation_type") == "CONTROL"),
              "IEC104_CONTROL_WITHOUT_STARTDT")
        .when((proto == "DNP3") & (fc == 4) & ~F.coalesce(F.col("_last_fc").isin(3, 4), F.lit(False)),
              "DNP3_OPERATE_WITHOUT_SELECT"))
    fired = rows.withColumn("_violation", violation).where(F.col("_violation").isNotNull())
    return alert(fired, "OT_PROTOCOL_STATE_VIOLATION", "HIGH", confidence=0.70, mitre=["T0855", "T0831"],
                 evidence={"violation_type": F.col("_violation")})
