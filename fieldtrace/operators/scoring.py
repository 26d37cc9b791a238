"""Threat scores of sources along the kill chain."""

from __future__ import annotations


from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.chains import contains_any
from fieldtrace.operators.shaping import severity_name, severity_rank

# fixed values: alert types of each phase, in lookup order
PHASE_TYPES = [
    ("RECONNAISSANCE", ["IT_PORT_SCAN_FAST", "IT_PORT_SCAN_SLOW", "HTTP_RAPID_REQUESTS", "HTTP_SUSPICIOUS_USER_AGENT",
                        "HTTP_DIRECTORY_BRUTEFORCE", "HTTP_HTTP_SCANNER_DETECTION", "OT_DEVICE_DISCOVERY"]),
    ("INITIAL_ACCESS", ["IT_BRUTE_FORCE", "IT_ADMIN_PORT_ATTACK_SSH", "IT_ADMIN_PORT_ATTACK_RDP",
                        "IT_ADMIN_PORT_ATTACK_TELNET", "HTTP_SQL_INJECTION", "HTTP_PATH_TRAVERSAL"]),
    ("EXECUTION", ["HTTP_WEBSHELL", "HTTP_WEBSHELL_CMD", "HTTP_DECODED_WEBSHELL", "HTTP_COMMAND_INJECTION"]),
    ("PERSISTENCE", ["HTTP_WEBSHELL_UPLOAD"]),
    ("LATERAL_MOVEMENT", ["IT_LATERAL_MOVEMENT_SMB"]),
    ("COMMAND_AND_CONTROL", ["C2_BEACON_REGULAR", "C2_BEACON_JITTER", "DNS_TUNNEL_ENTROPY", "DNS_TUNNEL_SUBDOMAIN_DIVERSITY"]),
    ("EXFILTRATION", ["DATA_EXFIL_LARGE_TRANSFER", "DATA_EXFIL_CUMULATIVE", "DNS_TUNNEL_TXT_ABUSE"]),
    ("EXECUTION", ["POST_EXPLOIT_SHELL_SESSION"]),
    ("CREDENTIAL_ACCESS", ["POST_EXPLOIT_CREDENTIAL_EXPOSURE"]),
    ("COLLECTION", ["POST_EXPLOIT_SENSITIVE_FILE_READ"]),
    ("PRIVILEGE_ESCALATION", ["POST_EXPLOIT_PRIVILEGE_ESCALATION"]),
    ("LATERAL_MOVEMENT", ["POST_EXPLOIT_LATERAL_MOVEMENT_CREDS"]),
    ("DISCOVERY", ["POST_EXPLOIT_INTERNAL_RECON"]),
    ("EXFILTRATION", ["POST_EXPLOIT_SHELL_DATA_EXFIL"]),
    ("IMPACT", ["RAPID_WRITE_SEQUENCE", "ABNORMAL_WRITE_RATE", "OT_PLC_STOP", "OT_FIRMWARE_UPDATE", "OT_PROGRAM_DOWNLOAD",
                "ARP_SPOOFING_DETECTED"]),
]
# fixed values: words that give a phase to other types
PHASE_WORDS = [
    ("RECONNAISSANCE", ["scan", "discovery", "enum"]), ("INITIAL_ACCESS", ["brute", "access"]),
    ("EXECUTION", ["webshell", "exec", "command"]), ("LATERAL_MOVEMENT", ["lateral", "smb"]),
    ("COMMAND_AND_CONTROL", ["c2", "beacon"]), ("EXFILTRATION", ["exfil", "tunnel"]), ("IMPACT", ["write", "stop", "firmware"]),
]
# fixed values: usual next phase and its likelihood
NEXT_PHASE = {
    "RECONNAISSANCE": ("INITIAL_ACCESS", 0.8), "INITIAL_ACCESS": ("EXECUTION", 0.7), "EXECUTION": ("PERSISTENCE", 0.6),
    "PERSISTENCE": ("LATERAL_MOVEMENT", 0.7), "PRIVILEGE_ESCALATION": ("LATERAL_MOVEMENT", 0.8),
    "LATERAL_MOVEMENT": ("COLLECTION", 0.6), "COLLECTION": ("EXFILTRATION", 0.7), "COMMAND_AND_CONTROL": ("IMPACT", 0.6),
    "DISCOVERY": ("LATERAL_MOVEMENT", 0.7),
}


@dataclass(frozen=True)
class Weights:
    """Weights of the score (fixed default values)."""
    severity: dict = field(default_factory=lambda: {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.2})
    phase: dict = field(default_factory=lambda: {
        "RECONNAISSANCE": 0.3, "RESOURCE_DEVELOPMENT": 0.4, "INITIAL_ACCESS": 0.6, "EXECUTION": 0.8, "PERSISTENCE": 0.85,
        "PRIVILEGE_ESCALATION": 0.9, "DEFENSE_EVASION": 0.7, "CREDENTIAL_ACCESS": 0.75, "DISCOVERY": 0.5,
        "LATERAL_MOVEMENT": 0.85, "COLLECTION": 0.7, "COMMAND_AND_CONTROL": 0.9, "EXFILTRATION": 0.95, "IMPACT": 1.0})
    ot_bonus: float = 0.3
    malware_bonus: float = 0.5
    decay_hours: float = 24.0


def _lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def kill_chain_phase(kind: Column) -> Column:
    """Exact type, then a known type inside the name, then a word; null otherwise."""
    exact = {t: phase for phase, types in PHASE_TYPES for t in types}
    table = F.create_map(*[x for t, p in exact.items() for x in (F.lit(t), F.lit(p))])
    inside = [F.when(kind.contains(t), F.lit(p)) for t, p in exact.items()]
    words = [F.when(contains_any(F.lower(kind), w), F.lit(p)) for p, w in PHASE_WORDS]
    return F.coalesce(F.element_at(table, kind), *inside, *words)


def touches_ot(kind: Column, protocol: Column, anywhere: bool = False) -> Column:
    """Industrial impact by type prefix ``OT_`` (``anywhere``: the letters OT in any place) or protocol."""
    p = F.coalesce(protocol, F.lit(""))
    return (kind.contains("OT") if anywhere else kind.startswith("OT_")) | p.contains("MODBUS") | p.contains("S7")


def threat_score(alerts: DataFrame, malware: DataFrame | None = None, weights: Weights = Weights(),
                 as_of_us: int | None = None, ot_anywhere: bool = False) -> DataFrame:
    """Score per source from phases, industrial impact and malware.

    Aggregated in two steps, (source, phase) then source, so a loud source is
    reduced to at most fourteen rows on the way. ``as_of_us`` decays old activity.
    """
    rows = alerts.select("ts_us", "seq", "src_ip", "dst_ip", "severity", "confidence", "protocol", "anomaly_type",
                         kill_chain_phase(F.col("anomaly_type")).alias("phase"))
    rows = rows.withColumn("ot", touches_ot(F.col("anomaly_type"), F.col("protocol"), ot_anywhere))
    per = rows.groupBy("src_ip", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.max(severity_rank(F.col("severity"))).alias("sev"), F.max("confidence").alias("conf"),
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.max(F.struct("ts_us", "seq")).alias("at"), F.max("ot").alias("ot"))
    part = (_lookup(weights.severity, severity_name(F.col("sev")), 0.2) * F.col("n") * _lookup(weights.phase, F.col("phase"), 0.5)
            * F.col("conf"))
    named = F.col("phase").isNotNull()
    score = per.groupBy("src_ip").agg(
        F.coalesce(F.sum(F.when(named, part)), F.lit(0.0)).alias("base"), F.count_if(named).alias("phase_count"),
        F.sum("n").alias("alerts"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.max("ot").alias("has_ot_impact"),
        F.max(F.when(named, F.struct(F.col("at.ts_us").alias("t"), F.col("at.seq").alias("s"), "phase"))).getField("phase").alias("current_phase"))
    if malware is not None:
        hits = malware.groupBy("src_ip").agg(
            F.count(F.lit(1)).alias("malware_hits"),
            F.sum(F.when(F.col("severity") == "CRITICAL", 1.0).when(F.col("severity") == "HIGH", 0.7).otherwise(0.0)).alias("_m"))
        score = score.join(hits, "src_ip", "left")
    else:
        score = score.withColumn("malware_hits", F.lit(None).cast("long")).withColumn("_m", F.lit(None).cast("double"))
    score = score.withColumn("malware_hits", F.coalesce("malware_hits", F.lit(0).cast("long"))).withColumn(
        "has_ot_impact", F.col("has_ot_impact") | (F.col("malware_hits") > 0))
    total = F.col("base") * F.when(F.col("phase_count") >= 3, 1.2).otherwise(1.0) * F.when(F.col("phase_count") >= 5, 1.3).otherwise(1.0)
    total = total * F.when(F.col("has_ot_impact"), 1.0 + weights.ot_bonus).otherwise(1.0)
    total = total + F.coalesce("_m", F.lit(0.0)) * weights.malware_bonus
    if as_of_us is not None:
        total = total * F.exp(-(F.lit(as_of_us) - F.col("last_us")) / F.lit(3.6e9 * weights.decay_hours))
    score = score.withColumn("total_score", total).withColumn(
        "normalized_score", F.least(F.lit(1.0), F.col("total_score") / (F.col("total_score") + 5.0)))
    norm = F.col("normalized_score")
    return score.drop("base", "_m").withColumn(
        "threat_level", F.when((norm >= 0.8) | (F.col("malware_hits") > 0), "CRITICAL").when(norm >= 0.6, "HIGH")
        .when(norm >= 0.3, "MEDIUM").otherwise("LOW"))


def predict_next_phase(scores: DataFrame) -> DataFrame:
    """Likely next phase of each source."""
    usual = F.create_map(*[x for k, (n, p) in NEXT_PHASE.items()
                           for x in (F.lit(k), F.struct(F.lit(n).alias("next"), F.lit(p).alias("p")))])
    known = F.element_at(usual, F.col("current_phase"))

    def pick(ot, unknown, mapped, default):
        return (F.when(F.col("current_phase").isNull(), unknown)
                .when(F.col("has_ot_impact") & (F.col("current_phase") != "IMPACT"), ot)
                .when(known.isNotNull(), mapped).otherwise(default))
    return (scores.withColumn("next_phase", pick(F.lit("IMPACT"), F.lit("RECONNAISSANCE"), known["next"], F.lit("IMPACT")))
            .withColumn("next_probability", pick(F.lit(0.8), F.lit(0.5), known["p"], F.lit(0.5))))


LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def at_least(scores: DataFrame, level: str) -> DataFrame:
    return scores.where(F.col("threat_level").isin(LEVELS[LEVELS.index(level):]))


def critical_ips(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("threat_level") == "CRITICAL").select("src_ip")


def ot_targeting_ips(scores: DataFrame) -> DataFrame:
    return scores.where("has_ot_impact").select("src_ip")


def threat_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("threat_level").agg(
        F.count(F.lit(1)).alias("ips"), F.count_if("has_ot_impact").alias("ot_targeting"), F.sum("malware_hits").alias("malware"),
        F.sum("alerts").alias("alerts"))


def top_threats(scores: DataFrame, limit: int = 10) -> DataFrame:
    return scores.orderBy(F.desc(F.round("total_score", 9)), "src_ip").limit(limit)


# fixed values: advice by level, extra advice when the process is reached or malware was seen
ADVICE = {
    "CRITICAL": (["Isolate the source address from the network now", "Alert the security team now"],
                 ["Isolate the affected plant segment now", "Verify the integrity of the devices now"],
                 ["Secure evidence before cleaning up", "Contact the responsible authority"]),
    "HIGH": (["Investigate the source address", "Consider blocking it at the firewall"],
             ["Watch the plant segment closely", "Review access rights to the devices"], []),
    "MEDIUM": (["Keep watching the source address", "Review its access logs", "Consider the watchlist"], [], []),
    "LOW": (["Log and watch"], [], []),
}


def threat_report(scores: DataFrame) -> DataFrame:
    """One nested row per source with what to do about it."""
    rows = predict_next_phase(scores)
    none = F.array().cast("array<string>")

    def texts(values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")
    advice = none
    for level, (always, ot, malware) in ADVICE.items():
        full = F.concat(texts(always), F.when(F.col("has_ot_impact"), texts(ot)).otherwise(none),
                        F.when(F.col("malware_hits") > 0, texts(malware)).otherwise(none))
        advice = F.when(F.col("threat_level") == level, full).otherwise(advice)
    return rows.select(
        F.col("src_ip").alias("ip"), "threat_level", F.round("total_score", 2).alias("total_score"),
        F.round("normalized_score", 3).alias("normalized_score"),
        F.struct("first_us", "last_us", (F.col("last_us") - F.col("first_us")).alias("span_us")).alias("timeline"),
        F.struct("phase_count", "current_phase", "next_phase", "next_probability").alias("kill_chain"),
        F.col("has_ot_impact"), F.col("malware_hits"), advice.alias("recommendations"))


