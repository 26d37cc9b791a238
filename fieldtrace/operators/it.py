"""Detectors over TCP segments, DNS questions, ARP packets and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.operators.anchored import anchored, cooled
from fieldtrace.operators.settle import settle
from fieldtrace.operators.shaping import alert
from fieldtrace.operators.sliced import HOUR, first_rows, numbered, rolling, running, running_distinct, seconds, slice_of
from fieldtrace.functions.text import shannon_entropy

# fixed values: administration ports and the services behind them
ADMIN_PORTS = {22: "SSH", 23: "TELNET", 3389: "RDP", 445: "SMB", 5900: "VNC", 5985: "WINRM", 5986: "WINRM-HTTPS",
               135: "RPC", 139: "NETBIOS"}
SMB_PORTS = [445, 139, 135]
# fixed values: beacon periods of interest, in seconds
BEACON_RANGES = [(30, 120), (300, 900), (3600, 7200)]

SYN, RST, ACK = 0x02, 0x04, 0x10


def connection_attempts(segments: DataFrame) -> DataFrame:
    """Initial SYNs only: scans, admin ports, lateral movement and beacons count attempts."""
    return segments.where((F.col("tcp_flags").bitwiseAND(SYN) != 0) & (F.col("tcp_flags").bitwiseAND(ACK) == 0))


def resets(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("tcp_flags").bitwiseAND(RST) != 0)


def _lookup(names: dict, key: Column, default: Column) -> Column:
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, key), default)


def port_scan(segments: DataFrame, window_s: float = 10.0, min_ports: int = 25, kind: str = "IT_PORT_SCAN_FAST",
              repeat_s: float = 60.0) -> DataFrame:
    """More than ``min_ports`` distinct ports within one window anchored at a source's first attempt.

    Ports are deduplicated per (source, window, port) before anything is grouped, so
    a flood on few ports shrinks on the map side, and only the first
    ``min_ports + 1`` ports of a window are ever collected.
    """
    attempts = connection_attempts(segments).select("ts_us", "seq", "src_ip", "dst_port")
    windows = anchored(attempts, ["src_ip"], seconds(window_s), strict=True)
    firsts = windows.groupBy("src_ip", "mark_us", "dst_port").agg(F.min(F.struct("ts_us", "seq")).alias("at"))
    kept = first_rows(firsts, ["src_ip", "mark_us"], ["at"], k=min_ports + 1)
    scans = (kept.groupBy("src_ip", "mark_us")
             .agg(F.count(F.lit(1)).alias("ports"), F.max("at").alias("at"),
                  F.array_sort(F.collect_list("dst_port")).alias("list"))
             .where(F.col("ports") > min_ports)
             .select("src_ip", "ports", F.col("at.ts_us").alias("ts_us"), F.col("at.seq").alias("seq"), "list"))
    scans = cooled(scans, ["src_ip"], seconds(repeat_s))
    pairs = F.aggregate(F.sequence(F.lit(1), F.size("list") - 1), F.lit(0),
                        lambda n, i: n + F.when(F.element_at("list", i + 1) - F.element_at("list", i) == 1, 1).otherwise(0))
    sequential = pairs > F.col("ports") * 0.3
    fast = kind.endswith("FAST")
    return alert(scans.withColumn("_seq", sequential), kind,
                 F.when(F.col("_seq"), "HIGH").otherwise("MEDIUM") if fast else "MEDIUM", dst=F.lit("Multiple"),
                 protocol=F.lit("TCP/UDP"), mitre=["T1046", "T0841"],
                 confidence=F.when(F.col("_seq"), 0.95).otherwise(0.75) if fast else 0.80,
                 evidence={"ports_scanned": F.col("ports"),
                           "pattern": F.when(F.col("_seq"), "sequential").otherwise("random")})


def port_scan_slow(segments: DataFrame, window_s: float = 300.0, min_ports: int = 60) -> DataFrame:
    return port_scan(segments, window_s, min_ports, "IT_PORT_SCAN_SLOW")


def admin_port_attack(segments: DataFrame, window_s: float = 300.0, limit: int = 10) -> DataFrame:
    attempts = connection_attempts(segments).where(F.col("dst_port").isin(list(ADMIN_PORTS))).select(
        "ts_us", "seq", "src_ip", "dst_ip", "dst_port")
    rows = rolling(attempts, ["src_ip", "dst_ip", "dst_port"], seconds(window_s), {"n": ("count", None)})
    service = _lookup(ADMIN_PORTS, F.col("dst_port"), F.lit(""))
    return alert(rows.where(F.col("n") > limit), F.concat(F.lit("IT_ADMIN_PORT_ATTACK_"), service),
                 F.when(F.col("dst_port").isin(23, 3389), "CRITICAL").otherwise("HIGH"), protocol=F.lit("TCP"),
                 mitre=["T1110", "T1021"], confidence=0.85,
                 evidence={"port": F.col("dst_port"), "connection_count": F.col("n")})


def brute_force(segments: DataFrame, window_s: float = 60.0, limit: int = 5) -> DataFrame:
    rows = rolling(resets(segments).select("ts_us", "seq", "src_ip", "dst_ip", "dst_port"),
                   ["src_ip", "dst_ip", "dst_port"], seconds(window_s), {"n": ("count", None)})
    return alert(rows.where(F.col("n") > limit), "IT_BRUTE_FORCE", "HIGH", protocol=F.lit("TCP"), mitre=["T1110"],
                 confidence=0.90, evidence={"port": F.col("dst_port"), "failed_count": F.col("n")})


def lateral_movement(segments: DataFrame, limit: int = 5, ports: list[int] | None = None) -> DataFrame:
    """A source reaching more and more hosts on file-sharing ports; targets never expire."""
    attempts = connection_attempts(segments).where(F.col("dst_port").isin(ports or SMB_PORTS)).select(
        "ts_us", "seq", "src_ip", "dst_ip")
    rows = running_distinct(attempts, ["src_ip"], "dst_ip", "targets")
    return alert(rows.where(F.col("targets") > limit), "IT_LATERAL_MOVEMENT_SMB", "CRITICAL", dst=F.lit("Multiple"),
                 protocol=F.lit("SMB"), mitre=["T1021.002", "T1570"], confidence=0.88,
                 evidence={"targets_count": F.col("targets")})


# --------------------------------------------------------------------------- DNS

def with_subdomain(dns: DataFrame) -> DataFrame:
    """Split names into registered domain (last two labels) and the rest."""
    labels = F.split("qname", "\\.")
    count = F.size(labels)
    sub = F.when(count > 2, F.array_join(F.slice(labels, 1, F.greatest(count - 2, F.lit(1))), ".")).otherwise("")
    domain = F.when(count > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("qname"))
    return settle(dns.where(F.col("qname").contains(".")), subdomain=sub, domain=domain)


def dns_txt_rate(dns: DataFrame, window_s: float = 60.0, limit: int = 20) -> DataFrame:
    texts = with_subdomain(dns).where(F.col("qtype") == 16).select("ts_us", "seq", "src_ip", "dst_ip", "domain")
    rows = rolling(texts, ["src_ip"], seconds(window_s), {"n": ("count", None)})
    return alert(rows.where(F.col("n") > limit), "DNS_TUNNEL_TXT_ABUSE", "HIGH", protocol=F.lit("DNS"),
                 mitre=["T1071.004"], confidence=0.85, evidence={"txt_count": F.col("n"), "domain": F.col("domain")})


def dns_long_subdomain(dns: DataFrame, limit: int = 50) -> DataFrame:
    rows = with_subdomain(dns).where(F.length("subdomain") > limit)
    return alert(rows, "DNS_TUNNEL_LONG_QUERY", "HIGH", protocol=F.lit("DNS"), mitre=["T1071.004", "T1048.003"],
                 confidence=0.80, evidence={"subdomain_length": F.length("subdomain"), "domain": F.col("domain")})


def dns_entropy(dns: DataFrame, min_entropy: float = 3.5, min_length: int = 10) -> DataFrame:
    rows = (with_subdomain(dns).where(F.length("subdomain") > min_length)
            .withColumn("entropy", shannon_entropy(F.encode("subdomain", "UTF-8")))
            .where(F.col("entropy") > min_entropy))
    return alert(rows, "DNS_TUNNEL_ENTROPY", "CRITICAL", protocol=F.lit("DNS"), mitre=["T1071.004", "T1048.003"],
                 confidence=0.90, evidence={"entropy": F.col("entropy"), "subdomain": F.col("subdomain")})


def dns_subdomain_diversity(dns: DataFrame, limit: int = 100) -> DataFrame:
    rows = running_distinct(with_subdomain(dns).select("ts_us", "seq", "src_ip", "dst_ip", "subdomain", "domain"),
                            ["src_ip", "domain"], "subdomain", "unique")
    return alert(rows.where(F.col("unique") > limit), "DNS_TUNNEL_SUBDOMAIN_DIVERSITY", "CRITICAL",
                 protocol=F.lit("DNS"), mitre=["T1071.004", "T1048.003"], confidence=0.95,
                 evidence={"unique_subdomains": F.col("unique"), "domain": F.col("domain")})


# --------------------------------------------------------------------------- ARP

def arp_spoofing(arp: DataFrame, window_s: float = 300.0, limit: int = 1) -> DataFrame:
    rows = rolling(arp.select("ts_us", "seq", "sender_ip", "sender_mac"), ["sender_ip"], seconds(window_s),
                   {"macs": ("distinct", F.col("sender_mac"))})
    return alert(rows.where(F.col("macs") > limit), "ARP_SPOOFING_DETECTED", "CRITICAL", src="sender_ip",
                 dst=F.lit("Network"), protocol=F.lit("ARP"), mitre=["T1557.002", "T1040"], confidence=0.92,
                 evidence={"macs": F.col("macs")})


def gratuitous_arp(arp: DataFrame, window_s: float = 60.0, limit: int = 10) -> DataFrame:
    rows = rolling(arp.where("is_gratuitous").select("ts_us", "seq", "sender_ip", "sender_mac"), ["sender_ip"],
                   seconds(window_s), {"n": ("count", None)})
    return alert(rows.where(F.col("n") > limit), "GRATUITOUS_ARP_ABUSE", "HIGH", src="sender_ip", dst=F.lit("Network"),
                 protocol=F.lit("ARP"), mitre=["T1557.002"], confidence=0.85,
                 evidence={"count": F.col("n"), "mac": F.col("sender_mac")})


def arp_storm(arp: DataFrame, window_s: float = 10.0, limit: int = 100) -> DataFrame:
    rows = rolling(arp.select("ts_us", "seq", "sender_ip"), ["sender_ip"], seconds(window_s), {"n": ("count", None)})
    return alert(rows.where(F.col("n") > limit), "ARP_STORM", "HIGH", src="sender_ip", dst=F.lit("Network"),
                 protocol=F.lit("ARP"), mitre=["T1557.002"], confidence=0.80, evidence={"count": F.col("n")})


# --------------------------------------------------------------------------- transfers

def exfil_large(flows: DataFrame, large_bytes: int = 10_000_000) -> DataFrame:
    return alert(flows.where(F.col("bytes") > large_bytes), "DATA_EXFIL_LARGE_TRANSFER", "CRITICAL",
                 protocol=F.lit("TCP"), mitre=["T1041", "T1048"], confidence=0.85, evidence={"bytes": F.col("bytes")})


def exfil_unusual_hours(flows: DataFrame, window_s: float = 600.0, limit: int = 10_000_000, start: int = 22,
                        end: int = 6) -> DataFrame:
    rows = rolling(flows.select("ts_us", "seq", "src_ip", "dst_ip", "bytes"), ["src_ip", "dst_ip"], seconds(window_s),
                   {"recent": ("sum", F.col("bytes"))})
    hour = F.hour(F.timestamp_micros("ts_us"))
    fired = rows.withColumn("hour", hour).where(((F.col("hour") >= start) | (F.col("hour") < end))
                                                & (F.col("recent") > limit))
    return alert(fired, "DATA_EXFIL_UNUSUAL_HOURS", "HIGH", protocol=F.lit("TCP"), mitre=["T1048"], confidence=0.75,
                 evidence={"bytes": F.col("recent"), "hour": F.col("hour")})


def exfil_hourly(flows: DataFrame, limit: int = 100_000_000) -> DataFrame:
    """Bytes so far in the clock hour, per source and destination."""
    rows = flows.withColumn("hour", slice_of(F.col("ts_us"), HOUR))
    w = (Window.partitionBy("src_ip", "dst_ip", "hour").orderBy("ts_us", "seq")
         .rowsBetween(Window.unboundedPreceding, 0))
    fired = rows.withColumn("hourly", F.sum("bytes").over(w)).where(F.col("hourly") > limit)
    return alert(fired, "DATA_EXFIL_CUMULATIVE", "CRITICAL", protocol=F.lit("TCP"), mitre=["T1041", "T1048"],
                 confidence=0.90, evidence={"hourly_bytes": F.col("hourly")})


def exfiltration(flows: DataFrame, min_bytes: int = 1000, **limits) -> DataFrame:
    """One alert per transfer: large beats unusual hours beats the hourly total."""
    rows = flows.where(F.col("bytes") > min_bytes)
    ranked = (exfil_large(rows, limits.get("large_bytes", 10_000_000)).withColumn("_r", F.lit(1))
              .unionByName(exfil_unusual_hours(rows, limit=limits.get("recent_bytes", 10_000_000)).withColumn("_r", F.lit(2)))
              .unionByName(exfil_hourly(rows, limits.get("hourly_bytes", 100_000_000)).withColumn("_r", F.lit(3))))
    return first_rows(ranked, ["ts_us", "seq", "src_ip", "dst_ip"], ["_r"]).drop("_r", "_rank")


# --------------------------------------------------------------------------- beacons

def c2_beacon(segments: DataFrame, min_count: int = 10, every: int = 5, keep: int | None = None, cut: int = 30,
              regular: float = 0.15, jitter: float = 0.30, ranges=None) -> DataFrame:
    """Connection attempts at regular intervals.

    A key is judged on all its attempts so far, or with ``keep`` on a retained history: all attempts up to ``keep``, then the
    last ``cut`` growing to ``keep`` again. Such a history of attempt number r starts
    at 1, or at ``keep - cut + 2 + (keep - cut + 1) * m``, so attempts are dealt to
    the few histories that contain them and each history is at most ``keep`` rows.
    """
    keys = ["src_ip", "dst_ip", "dst_port"]
    attempts = connection_attempts(segments).select("ts_us", "seq", *keys)
    judged = _judged_on_all(attempts, keys) if keep is None else _judged_on_kept(attempts, keys, keep, cut)
    spans = F.lit(False)
    for lo, hi in ranges or BEACON_RANGES:
        spans = spans | F.col("mean").between(lo, hi)
    cv = F.col("std") / F.col("mean")
    fired = judged.where((F.col("n") >= min_count) & (F.col("n") % every == 0) & (F.col("mean") > 0) & spans & (cv < jitter))
    strong = cv < regular
    return alert(fired, F.when(strong, "C2_BEACON_REGULAR").otherwise("C2_BEACON_JITTER"),
                 F.when(strong, "CRITICAL").otherwise("HIGH"), protocol=F.lit("TCP"), mitre=["T1071", "T1573"],
                 confidence=F.when(strong, 0.92).otherwise(0.75),
                 evidence={"connection_count": F.col("n"), "mean_interval": F.col("mean"), "cv": cv,
                           "port": F.col("dst_port")})


def _judged_on_all(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts with their number and the mean and deviation of all gaps so far, from sums along the key."""
    rows = running(attempts, keys, {"_prev": ("prev", F.col("ts_us"))})
    gap = F.coalesce((F.col("ts_us") - F.col("_prev")) / 1e6, F.lit(0.0))
    rows = running(rows.withColumn("_gap", gap), keys, {"n": ("sum", F.lit(1).cast("long")), "_sum": ("sum", F.col("_gap")), "_squares": ("sum", F.col("_gap") * F.col("_gap"))})
    gaps = F.when(F.col("n") > 1, F.col("n") - 1)
    rows = rows.withColumn("mean", F.col("_sum") / gaps)
    return rows.withColumn("std", F.sqrt(F.greatest(F.col("_squares") / gaps - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("_prev", "_gap", "_sum", "_squares")


def _judged_on_kept(attempts: DataFrame, keys: list[str], keep: int, cut: int) -> DataFrame:
    step = keep - cut + 1
    rows = numbered(attempts, keys)
    rn = F.col("rn")
    low = F.greatest(F.ceil((rn - keep - step) / F.lit(step)), F.lit(0))
    high = F.floor((rn - (keep - cut + 2)) / F.lit(step))
    later = F.when(high >= low, F.sequence(low + 1, high + 1)).otherwise(F.array().cast("array<bigint>"))
    groups = F.when(rn <= keep, F.concat(F.array(F.lit(0).cast("long")), later)).otherwise(later)
    dealt = rows.withColumn("_g", F.explode(groups))
    order = Window.partitionBy(*keys, "_g").orderBy("ts_us", "seq")
    dealt = (dealt.withColumn("_gap", (F.col("ts_us") - F.lag("ts_us").over(order)) / 1e6)
             .withColumn("n", F.row_number().over(order)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    judged = dealt.withColumn("mean", F.avg("_gap").over(upto)).withColumn("std", F.stddev_pop("_gap").over(upto))
    # attempts already judged in the history before are not judged again
    return judged.where((F.col("_g") == 0) | (F.col("n") >= cut))
