"""Known industrial malware families and attacker behaviour per source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.operators.ot import is_write
from fieldtrace.operators.shaping import alert
from fieldtrace.operators.sliced import rolling, seconds
from fieldtrace.session import stage


@dataclass(frozen=True)
class Signature:
    """Protocols, then codes, bytes or a port; without bytes the behaviour must agree."""
    id: str
    family: str
    protocols: tuple[str, ...]
    codes: tuple[int, ...] = ()
    payloads: tuple[bytes, ...] = ()
    port: int | None = None
    rate: bool = False
    per_second: float = 0.0
    many_targets: bool = False
    severity: str = "CRITICAL"
    confidence: float = 0.85
    mitre: tuple[str, ...] = field(default=())
    name: str = ""


# fixed values: the ordered catalogue (the first matching entry wins)
SIGNATURES = [
    Signature("TRITON_001", "TRITON", ("TRICONEX", "UDP"), payloads=(b"\x01\x00",), port=1502, rate=True, confidence=0.90,
              mitre=("T0831", "T0833", "T0857", "T0821"), name="TRITON - Triconex Protocol Reconnaissance"),
    Signature("INDUSTROYER_001", "INDUSTROYER", ("IEC_104",), (45, 46, 47, 48, 50), rate=True, per_second=10,
              confidence=0.92, mitre=("T0831", "T0813", "T0826"), name="INDUSTROYER - IEC 104 Rapid Commands"),
    Signature("STUXNET_001", "STUXNET", ("S7COMM",), (0x1A, 0x1B, 0x1C), confidence=0.93, mitre=("T0843", "T0833", "T0873"),
              name="STUXNET - S7 Program Block Injection"),
    Signature("PIPEDREAM_002", "PIPEDREAM", ("MODBUS_TCP",), (5, 6, 15, 16), rate=True, many_targets=True,
              confidence=0.88, mitre=("T0831", "T0836", "T0806"), name="PIPEDREAM - Modbus Mass Write"),
    Signature("FROSTYGOOP_001", "FROSTYGOOP", ("MODBUS_TCP",), (5, 6, 15, 16), rate=True, confidence=0.88,
              mitre=("T0831", "T0836", "T0826"),
              name="FROSTYGOOP - Heating System Manipulation"),
]
# fixed values: operation codes by protocol
PROGRAM_CODES = {"S7COMM": [0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F], "ENIP": [0x4D, 0x4F], "MODBUS_TCP": [90]}
STOP_CODES = {"S7COMM": [0x29], "DNP3": [0x12], "ENIP": [0x07]}
# columns of a recent detection, in the order that ranks them
RECENT = ["ts_us", "seq", "family", "severity", "name", "confidence"]


def operation_code() -> Column:
    """Function code; for EtherNet/IP the embedded CIP service recorded in the notes."""
    cip = F.conv(F.regexp_extract(F.coalesce("notes", F.lit("")), "CIP=0x([0-9A-Fa-f]{2})", 1), 16, 10).cast("int")
    return F.when((F.col("protocol") == "ENIP") & F.col("notes").contains("CIP=0x"), F.coalesce(cip, "function_code")
                  ).otherwise(F.col("function_code"))


def _match(sig: Signature, min_rate: int, min_targets: int) -> Column:
    fc = F.col("function_code").isin(list(sig.codes)) if sig.codes else F.lit(False)
    port = (F.col("dst_port") == sig.port) if sig.port is not None else F.lit(False)
    payload = F.lit(False)
    hits = F.lit(0)
    for pattern in sig.payloads:
        found = F.coalesce(F.contains("raw", F.lit(bytearray(pattern))), F.lit(False))
        payload, hits = payload | found, hits + found.cast("int")
    floor = max(min_rate, int(sig.per_second * 2))
    fast = (F.col("writes_minute") >= floor) if sig.rate else F.lit(False)
    wide = (F.col("write_targets") >= min_targets) if sig.many_targets else F.lit(False)
    agreed = F.when(payload, F.lit(0)).otherwise(fast.cast("int") + wide.cast("int"))
    score = (F.lit(sig.confidence) + 0.05 * fc.cast("int") + 0.1 * hits + 0.1 * port.cast("int") + 0.05 * agreed)
    return F.when(F.col("protocol").isin(list(sig.protocols)) & (fc | port | payload) & (payload | fast | wide),
                  F.struct(F.lit(sig.id).alias("id"), F.lit(sig.family).alias("family"), F.lit(sig.name).alias("name"), F.lit(sig.severity).alias("severity"),
                           F.least(F.lit(0.99), score).alias("confidence"),
                           F.array(*[F.lit(m) for m in sig.mitre]).alias("mitre")))


def malware_signature(events: DataFrame, signatures: list[Signature] | None = None, min_rate: int = 20,
                      min_targets: int = 3, rate_s: float = 60.0, history_s: float = 300.0) -> DataFrame:
    """First catalogue entry each event matches, given the source's recent writes."""
    base = events.select("ts_us", "seq", "src_ip", "dst_ip", "dst_port", "protocol", "function_code", "operation_type", "raw")
    rows = rolling(base, ["src_ip"], seconds(rate_s), {"writes_minute": ("count", is_write())})
    rows = rolling(rows, ["src_ip"], seconds(history_s), {"write_targets": ("distinct", F.col("dst_ip"), is_write())})
    found = F.array_compact(F.array(*[_match(s, min_rate, min_targets) for s in signatures or SIGNATURES]))
    fired = rows.withColumn("_all", found).where(F.size("_all") > 0).withColumn("_sig", F.element_at("_all", 1))
    return alert(fired, F.concat(F.lit("OT_MALWARE_"), F.col("_sig.family")), F.col("_sig.severity"),
                 confidence=F.col("_sig.confidence"), mitre=F.col("_sig.mitre"),
                 evidence={"signature_id": F.col("_sig.id"), "family": F.col("_sig.family"), "name": F.col("_sig.name"),
                           "writes_minute": F.col("writes_minute"), "write_targets": F.col("write_targets")})


def rapid_ot_writes(events: DataFrame, per_second: float = 10.0) -> DataFrame:
    rates = events.where(is_write()).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("writes"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    rates = (rates.where("hi > lo").withColumn("rate", F.col("writes") / ((F.col("hi") - F.col("lo")) / 1e6))
             .where(F.col("rate") >= per_second).withColumn("ts_us", F.col("hi")).withColumn("seq", F.lit(0)))
    return alert(rates, "BEHAVIORAL_RAPID_WRITES", "HIGH", dst=F.lit(""), protocol=F.lit(""), confidence=0.85,
                 mitre=["T0831", "T0806"], evidence={"write_count": F.col("writes"), "write_rate": F.col("rate")})


def multi_protocol_attack(events: DataFrame, protocols: int = 3, writes: int = 3) -> DataFrame:
    used = events.groupBy("src_ip").agg(F.array_sort(F.collect_set("protocol")).alias("used"),
                                        F.count_if(is_write()).alias("writes"), F.max("ts_us").alias("ts_us"))
    used = used.where((F.size("used") >= protocols) & (F.col("writes") >= writes)).withColumn("seq", F.lit(0))
    return alert(used, "BEHAVIORAL_MULTI_PROTOCOL", "CRITICAL", dst=F.lit(""), protocol=F.lit(""), confidence=0.88,
                 mitre=["T0831", "T0869"],
                 evidence={"protocols": F.array_join("used", ","), "attack_events": F.col("writes")})


def _first_code(events: DataFrame, codes: dict, kind: str, confidence: float, mitre: list[str]) -> DataFrame:
    hit = F.lit(False)
    for protocol, values in codes.items():
        hit = hit | ((F.col("protocol") == protocol) & operation_code().isin(values))
    first = events.where(hit).groupBy("src_ip").agg(
        F.min(F.struct("ts_us", "seq", "dst_ip", "protocol", "function_code")).alias("e"))
    first = first.select("src_ip", "e.*")
    return alert(first, kind, "CRITICAL", confidence=confidence, mitre=mitre,
                 evidence={"function_code": F.col("function_code")})


def program_modification(events: DataFrame) -> DataFrame:
    """First program transfer or firmware command of each source."""
    return _first_code(events, PROGRAM_CODES, "BEHAVIORAL_PROGRAM_MOD", 0.90, ["T0843", "T0833"])


def controller_stop(events: DataFrame) -> DataFrame:
    """First stop command of each source."""
    return _first_code(events, STOP_CODES, "BEHAVIORAL_CONTROLLER_STOP", 0.92, ["T0816", "T0813"])


def malware_summary(detections: DataFrame, limit: int = 10) -> DataFrame:
    """All detections in figures, and the last ones: a row for each ``part``. ``total`` counts all, ``severity`` the critical and the high ones (0 if there are none),
    ``family`` those of a family and severity, and ``recent`` has the last ``limit``, the latest at place 1; equal times and numbers are told apart by the other columns."""
    facts = stage(detections.select("ts_us", "seq", F.col("evidence")["family"].alias("family"), "severity", F.col("evidence")["name"].alias("name"), "confidence"))
    by_family = facts.groupBy("family", "severity").agg(F.count(F.lit(1)).alias("detections"))

    def counted(part: str, severity: str | None) -> Column:
        those = F.sum("detections") if severity is None else F.sum(F.when(F.col("severity") == severity, F.col("detections")))
        return F.struct(F.lit(part).alias("part"), F.lit(severity).cast("string").alias("severity"), F.coalesce(those, F.lit(0)).cast("long").alias("detections"))
    totals = by_family.agg(F.array(counted("total", None), counted("severity", "CRITICAL"), counted("severity", "HIGH")).alias("all")).select(F.inline("all"))
    last = recent_detections(facts, limit)
    latest = [F.desc(c) for c in RECENT]
    recent = last.select(F.lit("recent").alias("part"), F.row_number().over(Window.orderBy(*latest)).alias("place"), *RECENT)
    return (totals.unionByName(by_family.withColumn("part", F.lit("family")), allowMissingColumns=True)
            .unionByName(recent, allowMissingColumns=True).select("part", "place", "detections", *RECENT))


def recent_detections(detections: DataFrame, limit: int = 10) -> DataFrame:
    """The last detections; equal times and numbers are told apart by what else is known of them."""
    return detections.orderBy(*[F.desc(c) for c in RECENT if c in detections.columns]).limit(limit)
