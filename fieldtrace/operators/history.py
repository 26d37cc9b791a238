"""Queries over stored scans: sessions, their alerts and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import period
from fieldtrace.operators.shaping import severity_rank
from fieldtrace.operators.sliced import first_rows

LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def search_alerts(alerts: DataFrame, *, session_id=None, anomaly_type=None, severity=None, src_ip=None, start_us=None,
                  end_us=None, limit: int = 1000) -> DataFrame:
    """Newest alerts matching all given fields."""
    out = alerts
    for name, value in (("session_id", session_id), ("anomaly_type", anomaly_type), ("severity", severity), ("src_ip", src_ip)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if start_us is not None:
        out = out.where(F.col("ts_us") >= start_us)
    if end_us is not None:
        out = out.where(F.col("ts_us") <= end_us)
    return out.orderBy(F.desc("ts_us"), F.desc("seq")).limit(limit)


def since(sessions: DataFrame, cutoff_us: int) -> DataFrame:
    return sessions.where(F.col("started_us") >= cutoff_us)


def session_totals(sessions: DataFrame, cutoff_us: int) -> DataFrame:
    return since(sessions, cutoff_us).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.sum("total_packets").alias("total_packets"), F.sum("total_anomalies").alias("total_anomalies"))


def distribution(rows: DataFrame, sessions: DataFrame, cutoff_us: int, by: str) -> DataFrame:
    """Counts of stored rows of recent sessions; counted per session first, then joined."""
    part = rows.where(F.col(by).isNotNull()).groupBy("session_id", by).agg(F.count(F.lit(1)).alias("n"))
    return (part.join(since(sessions, cutoff_us).select("session_id"), "session_id")
            .groupBy(by).agg(F.sum("n").alias("count")))


def top_sources(alerts: DataFrame, sessions: DataFrame, cutoff_us: int, limit: int = 10) -> DataFrame:
    return distribution(alerts, sessions, cutoff_us, "src_ip").orderBy(F.desc("count"), "src_ip").limit(limit)


def ioc_types(iocs: DataFrame, sessions: DataFrame, cutoff_us: int) -> DataFrame:
    part = iocs.groupBy("session_id", "ioc_type").agg(F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("o"))
    return (part.join(since(sessions, cutoff_us).select("session_id"), "session_id").groupBy("ioc_type")
            .agg(F.sum("n").alias("unique"), F.sum("o").alias("total_occurrences")))


def by_severity(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(prefix + s.lower()) for s in LEVELS]


def attack_trends(alerts: DataFrame, interval: str = "day", cutoff_us: int = 0) -> DataFrame:
    """Alerts per hour, day or week by severity."""
    when = F.timestamp_micros("ts_us")
    return (alerts.where(F.col("ts_us") >= cutoff_us).groupBy(period(when, interval).alias("period"))
            .agg(F.count(F.lit(1)).alias("total_anomalies"), *by_severity()))


def ip_history(alerts: DataFrame, ip: str) -> DataFrame:
    return (alerts.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip)).groupBy("anomaly_type")
            .agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("total")))


def ip_sessions(alerts: DataFrame, sessions: DataFrame, ip: str, limit: int = 10) -> DataFrame:
    """Latest sessions an address took part in."""
    seen = alerts.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip)).select("session_id").distinct()
    return (sessions.join(seen, "session_id", "left_semi").select("session_id", "capture", "started_us")
            .orderBy(F.desc("started_us"), "session_id").limit(limit))


def get_iocs(iocs: DataFrame, *, session_id=None, ioc_type=None, limit: int = 1000) -> DataFrame:
    out = iocs
    if session_id is not None:
        out = out.where(F.col("session_id") == session_id)
    if ioc_type is not None:
        out = out.where(F.col("ioc_type") == ioc_type)
    return out.orderBy(F.desc("occurrences"), "value").limit(limit)


def search_iocs(iocs: DataFrame, sessions: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Indicators whose value matches a LIKE pattern anywhere, with their capture."""
    hits = iocs.where(F.col("value").like(f"%{pattern}%"))
    return (hits.join(sessions.select("session_id", "capture"), "session_id")
            .orderBy(F.desc("occurrences"), "value", "session_id").limit(limit))


def list_sessions(sessions: DataFrame, search: str = "", since_us: int | None = None, limit: int = 500) -> DataFrame:
    """Newest sessions; the search text has no wildcards."""
    out = sessions.where(F.lower("capture").contains(search.lower())) if search else sessions
    if since_us is not None:
        out = out.where(F.col("started_us") >= since_us)
    return out.orderBy(F.desc("started_us"), "session_id").limit(limit)


def session_overview(sessions: DataFrame, alerts: DataFrame, iocs: DataFrame, top: int = 8) -> DataFrame:
    """Sessions with severity counts, most frequent alert types and number of indicators."""
    levels = (alerts.groupBy("session_id", "severity").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id")
              .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severity")))
    types = alerts.groupBy("session_id", "anomaly_type").agg(F.count(F.lit(1)).alias("n"))
    best = first_rows(types, ["session_id"], [F.desc("n"), "anomaly_type"], k=top, name="rank")
    best = best.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "anomaly_type", "n"))).alias("top_types"))
    found = iocs.groupBy("session_id").agg(F.count(F.lit(1)).alias("ioc_count"))
    return (sessions.join(levels, "session_id", "left").join(best, "session_id", "left").join(found, "session_id", "left")
            .withColumn("ioc_count", F.coalesce("ioc_count", F.lit(0).cast("long"))))


def compare_sessions(alerts: DataFrame, older: str, newer: str) -> DataFrame:
    """Alert types that appeared, disappeared or changed in number between two scans."""
    both = alerts.where(F.col("session_id").isin(older, newer)).groupBy("anomaly_type").agg(
        F.count_if(F.col("session_id") == older).alias("old_n"), F.count_if(F.col("session_id") == newer).alias("new_n"))
    status = (F.when(F.col("old_n") == 0, "new").when(F.col("new_n") == 0, "resolved")
              .when(F.col("old_n") != F.col("new_n"), "changed"))
    return both.withColumn("status", status).where("status IS NOT NULL")


def compare_iocs(iocs: DataFrame, older: str, newer: str) -> DataFrame:
    """Indicators only in the newer or only in the older scan."""
    both = iocs.where(F.col("session_id").isin(older, newer)).groupBy("ioc_type", "value").agg(
        F.max((F.col("session_id") == older).cast("int")).alias("o"), F.max((F.col("session_id") == newer).cast("int")).alias("n"))
    return both.where("o <> n").select("ioc_type", "value", F.when(F.col("n") == 1, "new").otherwise("gone").alias("status"))


def gone_sessions(sessions: DataFrame, *, older_than_us: int | None = None, ids: list[str] = (), every: bool = False) -> DataFrame:
    """Ids of the sessions that go: older than a time, listed, or all."""
    gone = F.lit(every)
    if older_than_us is not None:
        gone = gone | (F.col("started_us") < older_than_us)
    if ids:
        gone = gone | F.col("session_id").isin(list(ids))
    return sessions.where(gone).select("session_id")


def retained(rows: DataFrame, sessions: DataFrame, **which) -> DataFrame:
    """Rows of the sessions that stay when old or listed sessions are deleted."""
    return rows.join(gone_sessions(sessions, **which), "session_id", "left_anti")


def upsert_ioc(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge sightings: unique per session, type and value; counts add up, known intelligence is kept until replaced.

    Both sides: ``(session_id, ioc_type, value, severity, first_us, last_us, occurrences, threat_intel)``.
    """
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "last_us")
    intel = F.when(F.col("threat_intel").isNotNull(), F.struct("_new", "last_us", "threat_intel"))
    return rows.groupBy("session_id", "ioc_type", "value").agg(
        F.min_by("severity", order).alias("severity"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.sum("occurrences").alias("occurrences"), F.max(intel).getField("threat_intel").alias("threat_intel"))


# --------------------------------------------------------------------------- one-capture summaries

def protocol_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))


def function_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("protocol", "function_code").agg(F.count(F.lit(1)).alias("n"))


def risk_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def conversation_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("src_ip", "dst_ip", "protocol").agg(F.count(F.lit(1)).alias("n"))


def ip_pair_bytes(segments: DataFrame) -> DataFrame:
    return segments.groupBy("src_ip", "dst_ip").agg(F.sum(F.col("ip_len").cast("long")).alias("bytes"))


def endpoint_packets(segments: DataFrame) -> DataFrame:
    return segments.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).groupBy("ip").agg(F.count(F.lit(1)).alias("packets"))


def port_counts(segments: DataFrame) -> DataFrame:
    name = F.when(F.col("ip_proto") == 6, "TCP").when(F.col("ip_proto") == 17, "UDP").otherwise("OTHER")
    return segments.groupBy(name.alias("transport"), "dst_port").agg(F.count(F.lit(1)).alias("n"))


def flag_counts(segments: DataFrame) -> DataFrame:
    """SYNs, resets and accepted connections in one pass."""
    def flag(bit):
        return F.col("tcp_flags").bitwiseAND(bit) != 0
    return segments.agg(F.count_if(flag(2)).alias("syn"), F.count_if(flag(4)).alias("rst"),
                        F.count_if(flag(2) & flag(16)).alias("synack"))


def synack_ports(segments: DataFrame) -> DataFrame:
    open_ = (F.col("tcp_flags").bitwiseAND(2) != 0) & (F.col("tcp_flags").bitwiseAND(16) != 0)
    return segments.where(open_).groupBy("src_ip").agg(F.array_sort(F.collect_set("src_port")).alias("ports"))


def capture_summary(events: DataFrame, alerts: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """One row: extent, counts and the greatest escalation."""
    e = events.agg(F.count(F.lit(1)).alias("ot_events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                   F.count_distinct("protocol").alias("protocols"),
                   F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high_risk_events"))
    a = alerts.agg(F.count(F.lit(1)).alias("anomalies"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    # one row each: a join on a constant, not a product of tables
    out = e.withColumn("_j", F.lit(1)).join(a.withColumn("_j", F.lit(1)), "_j")
    if chains is not None:
        c = chains.agg(F.count(F.lit(1)).alias("attack_chains"), F.coalesce(F.max("escalation"), F.lit(0.0)).alias("max_escalation"))
        out = out.join(c.withColumn("_j", F.lit(1)), "_j")
    return out.drop("_j").withColumn("duration_us", F.col("last_us") - F.col("first_us"))


def top_mitre(rows: DataFrame, limit: int = 10) -> DataFrame:
    return (rows.select(F.explode("mitre").alias("technique")).groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "technique").limit(limit))


def alert_overview(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """The alerts to look at first: CRITICAL, then HIGH, oldest first."""
    return (alerts.where(F.col("severity").isin("CRITICAL", "HIGH"))
            .orderBy(F.desc(severity_rank(F.col("severity"))), "ts_us", "seq").limit(limit))


def attack_sources(alerts: DataFrame, limit: int = 6) -> DataFrame:
    rows = alerts.where(F.coalesce("src_ip", F.lit("")) != "").groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_distinct("dst_ip").alias("targets"))
    return rows.orderBy(F.desc("critical"), F.desc("high"), F.desc("count"), "src_ip").limit(limit)


def attack_targets(alerts: DataFrame, limit: int = 6) -> DataFrame:
    rows = alerts.where(F.coalesce("dst_ip", F.lit("")) != "").groupBy("dst_ip").agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("src_ip").alias("sources"))
    return rows.orderBy(F.desc("count"), "dst_ip").limit(limit)
