"""Indicators of compromise and threat-feed matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.net import domain_parents
from fieldtrace.functions.scalar import formula_safe
from fieldtrace.operators.chains import contains_any
from fieldtrace.operators.shaping import severity_name, severity_rank
from fieldtrace.operators.sliced import first_rows

# fixed values: attack categories by words in the alert type, in order; "+" joins words that must all occur
CATEGORIES = [("WEBSHELL", ["WEBSHELL", "SHELL"]), ("SQL_INJECTION", ["SQL", "INJECTION"]), ("XSS", ["XSS"]),
              ("PORT_SCAN", ["SCAN", "PORT_SCAN"]), ("DNS_TUNNELING", ["DNS+TUNNEL"]), ("ARP_SPOOFING", ["ARP+SPOOF"]),
              ("C2_BEACON", ["C2", "BEACON"]), ("DATA_EXFILTRATION", ["EXFIL"]), ("BRUTE_FORCE", ["BRUTE"]),
              ("LATERAL_MOVEMENT", ["LATERAL", "SMB"]), ("HTTP_ATTACK", ["HTTP"]),
              ("OT_PROTOCOL_ATTACK", ["MODBUS", "S7", "PLC", "DNP3"])]
SUSPICIOUS_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".pw"]
SUSPICIOUS_URL_PARTS = ["cmd=", "exec=", "../", "..\\", "<script", "eval(", "base64", "shell", "/etc/passwd", "/etc/shadow"]
# fixed values: indicators shipped with the engine
BUILTIN_INDICATORS = [
    ("hash", "d63e3614d75ad0b7d8cd8c8f77f8dd8da8d2e5e5", "CRITICAL", "Industroyer/CrashOverride - Ukraine power grid attack"),
    ("hash", "a6357a8792e68b05690a9736bc3051cba4b43227", "CRITICAL", "Triton - Safety Instrumented Systems attack"),
    ("hash", "9c1d1dce651dd5f2e81ef4c7f8e5f4e1de0a3c7a", "CRITICAL", "Stuxnet - Iranian nuclear facility attack"),
    ("domain", "update.microsoft-office365.com", "CRITICAL", "Known APT C2 domain impersonating Microsoft"),
]
FEED_SCHEMA = "kind string, value string, severity string, description string"
_DOMAIN = r"^([a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"


def builtin_indicators(spark) -> DataFrame:
    return spark.createDataFrame(BUILTIN_INDICATORS, FEED_SCHEMA)


def builtin_sightings(seen: DataFrame) -> DataFrame:
    """The built-in indicators with their number of ``sightings`` among the rows ``(kind, value)``."""
    known = builtin_indicators(seen.sparkSession)
    counts = seen.join(F.broadcast(known.select("kind", "value")), ["kind", "value"], "left_semi").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("sightings"))
    return known.join(counts, ["kind", "value"], "left").withColumn("sightings", F.coalesce("sightings", F.lit(0)))


def attack_category(kind: Column) -> Column:
    text, out = F.upper(kind), []
    for name, words in CATEGORIES:
        test = F.lit(False)
        for word in words:
            both = F.lit(True)
            for part in word.split("+"):
                both = both & text.contains(part)
            test = test | both
        out.append(F.when(test, F.lit(name)))
    return F.coalesce(*out, F.lit("OTHER"))


def _few(rows: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """A sample, the first ``k`` distinct values per key (pruned in every map task before they meet), and ``<name>_n``, how many there are."""
    distinct = rows.where(F.coalesce(value, F.lit("")) != "").select(*keys, value).distinct()
    kept = first_rows(distinct, keys, [value], k=k).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))
    return kept.join(distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n")), keys)


def ioc_ips(scores: DataFrame, violations: DataFrame, chains: DataFrame | None = None, min_risk: float = 0.5) -> DataFrame:
    """Hosts with a high risk score, their violations and the chains they appear in."""
    risk = F.col("risk_score")
    seen = violations.groupBy("ip").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                                        F.count(F.lit(1)).alias("occurrences"))
    rows = scores.where(risk >= min_risk).join(seen, "ip", "left")
    if chains is not None:
        parts = chains.select("chain_id", F.explode(F.array_distinct(F.concat(F.array("source_ip"), "target_ips"))).alias("ip"))
        rows = rows.join(_few(parts, ["ip"], "chain_id", 3, "_c"), "ip", "left")
    else:
        rows = rows.withColumns({"_c": F.lit(None).cast("array<string>"), "_c_n": F.lit(0)})
    return rows.select(
        F.lit("IP").alias("ioc_type"), F.col("ip").alias("value"),
        F.when(risk >= 0.9, "CRITICAL").when(risk >= 0.7, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.coalesce("first_us", F.lit(0)).alias("first_us"), F.coalesce("last_us", F.lit(0)).alias("last_us"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        F.coalesce(F.array_join("_c", ", "), F.lit("Network Scan")).alias("context"),
        F.array().cast("array<string>").alias("associated_ips"), risk.alias("risk_score"), F.coalesce("_c_n", F.lit(0)).cast("long").alias("context_count"))


def ioc_hashes(payloads: DataFrame, alert_payloads: DataFrame | None = None) -> DataFrame:
    """First sighting per payload hash; decoded payloads before those found in alerts.

    Inputs: ``(ts_us, seq, sha256, kind, severity, src_ip, dst_ip)``.
    """
    cols = ["ts_us", "seq", "sha256", "kind", "severity", "src_ip", "dst_ip"]
    rows = payloads.select(*cols, F.lit(0).alias("_src"))
    if alert_payloads is not None:
        rows = rows.unionByName(alert_payloads.select(*cols, F.lit(1).alias("_src")))
    first = rows.where(F.coalesce("sha256", F.lit("")) != "").groupBy("sha256").agg(
        F.min(F.struct("_src", "ts_us", "seq", "kind", "severity", "src_ip", "dst_ip")).alias("f"))
    return first.select(F.lit("HASH").alias("ioc_type"), F.col("sha256").alias("value"), F.col("f.severity").alias("severity"),
                        F.col("f.ts_us").alias("first_us"), F.col("f.ts_us").alias("last_us"), F.lit(1).cast("long").alias("occurrences"),
                        F.col("f.kind").alias("context"),
                        F.filter(F.array("f.src_ip", "f.dst_ip"), lambda x: x != "").alias("associated_ips"),
                        F.lit(0.0).alias("risk_score"))


def ioc_mitre(alerts: DataFrame, chains: DataFrame | None = None, contexts: int = 5, ips: int = 10) -> DataFrame:
    """Techniques with their count, extent, worst severity and a few contexts and addresses."""
    uses = alerts.select(F.explode("mitre").alias("value"), "ts_us", F.col("ts_us").alias("end_us"),
                         severity_rank(F.col("severity")).alias("sev"), F.col("anomaly_type").alias("context"),
                         F.array("src_ip", "dst_ip").alias("ips"))
    if chains is not None:
        uses = uses.unionByName(chains.select(
            F.explode("techniques").alias("value"), F.col("start_us").alias("ts_us"), "end_us",
            severity_rank(F.col("severity")).alias("sev"), F.concat(F.lit("CHAIN:"), "chain_id").alias("context"),
            F.array("source_ip").alias("ips")))
    uses = uses.where(F.coalesce("value", F.lit("")) != "")
    total = uses.groupBy("value").agg(F.count(F.lit(1)).alias("occurrences"), F.min("ts_us").alias("first_us"),
                                      F.max("end_us").alias("last_us"), F.max("sev").alias("sev"))
    hosts = uses.select("value", F.explode("ips").alias("ip"))
    rows = (total.join(_few(uses, ["value"], "context", contexts, "_c"), "value", "left")
            .join(_few(hosts, ["value"], "ip", ips, "_i"), "value", "left"))
    return rows.select(F.lit("MITRE_TECHNIQUE").alias("ioc_type"), "value", severity_name(F.col("sev")).alias("severity"), "first_us",
                       "last_us", "occurrences", F.array_join("_c", ", ").alias("context"), F.col("_i").alias("associated_ips"),
                       F.lit(0.0).alias("risk_score"), F.coalesce("_c_n", F.lit(0)).cast("long").alias("context_count"), F.coalesce("_i_n", F.lit(0)).cast("long").alias("ip_count"))


def host_domain(host: Column) -> Column:
    """Host without port, null when it is an address or no domain."""
    name = F.trim(F.substring_index(host, ":", 1))
    good = name.rlike(_DOMAIN) & (F.length(name) <= 253) & ~name.rlike(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")
    return F.when(good, name)


def ioc_domains(alerts: DataFrame, ips: int = 10) -> DataFrame:
    """Domains named by alerts with a ``host``; rare top-level domains weigh more."""
    rows = alerts.withColumn("value", host_domain(F.col("host"))).where("value IS NOT NULL")
    serious = F.when(F.col("severity").isin("CRITICAL", "HIGH"), F.struct("ts_us", "seq", "severity"))
    total = rows.groupBy("value").agg(F.count(F.lit(1)).alias("occurrences"), F.min("ts_us").alias("first_us"),
                                      F.max("ts_us").alias("last_us"), F.max(serious).getField("severity").alias("worst"))
    tld = F.lit(False)
    for suffix in SUSPICIOUS_TLDS:
        tld = tld | F.col("value").endswith(suffix)
    hosts = rows.select("value", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return total.join(_few(hosts, ["value"], "ip", ips, "_i"), "value", "left").select(
        F.lit("DOMAIN").alias("ioc_type"), "value",
        F.coalesce("worst", F.when(tld, "MEDIUM"), F.lit("LOW")).alias("severity"), "first_us", "last_us", "occurrences",
        F.lit("HTTP Traffic").alias("context"), F.col("_i").alias("associated_ips"), F.lit(0.0).alias("risk_score"),
        F.coalesce("_i_n", F.lit(0)).cast("long").alias("ip_count"))


def ioc_urls(alerts: DataFrame, ips: int = 10, max_length: int | None = None) -> DataFrame:
    """URLs named by alerts with ``host`` and ``uri``; telling parts raise the severity."""
    url = F.when(F.col("uri").startswith("http"), F.col("uri")).otherwise(F.concat(F.lit("http://"), "host", "uri"))
    rows = (alerts.where((F.coalesce("host", F.lit("")) != "") & (F.coalesce("uri", F.lit("")) != ""))
            .withColumn("value", url))
    if max_length is not None:
        rows = rows.where(F.length("value") < max_length)
    total = rows.groupBy("value").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.max(F.struct("ts_us", "seq", "severity")).getField("severity").alias("last_severity"))
    telling = contains_any(F.lower("value"), SUSPICIOUS_URL_PARTS) & F.col("last_severity").isin("LOW", "MEDIUM")
    hosts = rows.select("value", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return total.join(_few(hosts, ["value"], "ip", ips, "_i"), "value", "left").select(
        F.lit("URL").alias("ioc_type"), "value", F.when(telling, "HIGH").otherwise(F.col("last_severity")).alias("severity"),
        "first_us", "last_us", "occurrences", F.lit("HTTP Traffic").alias("context"), F.col("_i").alias("associated_ips"),
        F.lit(0.0).alias("risk_score"), F.coalesce("_i_n", F.lit(0)).cast("long").alias("ip_count"))


def ioc_by_attack(alerts: DataFrame) -> DataFrame:
    """Sources per attack category."""
    rows = alerts.where(~F.coalesce("src_ip", F.lit("")).isin("", "Multiple", "Network"))
    return rows.groupBy(attack_category(F.col("anomaly_type")).alias("category"), "src_ip").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.min(F.struct("ts_us", "seq", "severity")).getField("severity").alias("severity"))


# --------------------------------------------------------------------------- feeds

def match_feed(rows: DataFrame, value: str, feeds: DataFrame, kind: str) -> DataFrame:
    """Rows whose address, hash or domain (a parent domain counts) is in the feed.

    No broadcast is forced: the planner picks one when the measured feed is small.
    """
    feed = feeds.where(F.col("kind") == kind).select(
        F.col("value").alias("_f"), F.col("severity").alias("feed_severity"), F.col("description").alias("feed_description"))
    if kind != "domain":
        key = F.lower(value) if kind == "hash" else F.trim(F.col(value))
        return rows.join(feed, key == F.col("_f")).withColumn("matched", F.col("_f")).withColumn(
            "feed_confidence", F.lit(0.95)).drop("_f")
    names = rows.select(F.col(value).alias("_v")).distinct()
    steps = names.withColumn("_p", F.explode(domain_parents(F.col("_v"))))
    hits = steps.join(feed, F.col("_p.domain") == F.col("_f"))
    nearest = hits.groupBy("_v").agg(F.min(F.struct(F.col("_p.depth").alias("depth"), F.col("_f"), "feed_severity",
                                                    "feed_description")).alias("h"))
    nearest = nearest.select("_v", F.col("h._f").alias("matched"), "h.feed_severity", "h.feed_description")
    return rows.join(nearest, F.col(value) == F.col("_v")).drop("_v").withColumn("feed_confidence", F.lit(0.95))


def enrich_anomalies(alerts: DataFrame, feeds: DataFrame, payload_hash: str | None = None) -> DataFrame:
    """Alerts with the feed findings for their source, destination and payload hash.

    Distinct indicators are matched, not alerts, so one address in most alerts is looked up once.
    """
    base = alerts.withColumn("_h", F.lower(payload_hash)) if payload_hash else alerts.withColumn("_h", F.lit(None).cast("string"))
    ip_feed = feeds.where("kind = 'ip'").select(F.col("value").alias("_v"), F.struct(
        F.lit("ip").alias("type"), "value", "severity", "description").alias("_f"))
    hash_feed = feeds.where("kind = 'hash'").select(F.col("value").alias("_v"), F.struct(
        F.lit("hash").alias("type"), "value", "severity", "description").alias("_f"))
    out = base
    for name, column, feed in (("_s", F.col("src_ip"), ip_feed),
                               ("_d", F.when(~F.col("dst_ip").isin("Multiple", "Network", ""), F.col("dst_ip")), ip_feed),
                               ("_p", F.col("_h"), hash_feed)):
        side = feed.select(F.col("_v").alias(f"{name}v"), F.col("_f").alias(name))
        out = out.join(side, column == F.col(f"{name}v"), "left").drop(f"{name}v")
    return out.withColumn("findings", F.array_compact(F.array("_s", "_d", "_p"))).drop("_s", "_d", "_p", "_h")


# --------------------------------------------------------------------------- watchlist

def watchlist_upsert(watchlist: DataFrame, entries: DataFrame, now_us: int) -> DataFrame:
    """New values are added; values already watched count one more hit per entry.

    ``watchlist(ioc_type, value, severity, hit_count, last_seen_us, is_active)``.
    """
    fresh = entries.groupBy("value").agg(F.min(F.struct("ioc_type", "severity")).alias("e"), F.count(F.lit(1)).alias("n"))
    rows = watchlist.join(fresh, "value", "full_outer")
    known = F.col("hit_count").isNotNull()
    return rows.select(
        F.coalesce("ioc_type", "e.ioc_type").alias("ioc_type"), "value", F.coalesce("severity", "e.severity").alias("severity"),
        F.when(known, F.col("hit_count") + F.coalesce("n", F.lit(0))).otherwise(F.col("n") - 1).alias("hit_count"),
        F.when(F.col("n").isNotNull(), F.lit(now_us)).otherwise(F.col("last_seen_us")).alias("last_seen_us"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"))


def watchlist_hits(watchlist: DataFrame, sightings: DataFrame) -> DataFrame:
    """Sightings ``(ioc_type, value)`` of active entries, counted per entry."""
    active = watchlist.where("is_active").select("ioc_type", "value", "severity")
    counts = sightings.groupBy("ioc_type", "value").agg(F.count(F.lit(1)).alias("hits"))
    return counts.join(active, ["ioc_type", "value"])


def csv_rows(iocs: DataFrame) -> DataFrame:
    """The flat thirteen-column export, safe to open in a spreadsheet."""
    def text(c):
        return formula_safe(F.coalesce(c, F.lit("")))

    def secs(c):
        return F.format_string("%.2f", F.col(c) / 1e6)
    have = set(iocs.columns)

    def opt(name, value):
        return value if name in have else F.lit("")
    return iocs.select(
        text(F.col("ioc_type")).alias("Type"), text(F.col("value")).alias("Value"), text(F.col("severity")).alias("Severity"),
        F.format_string("%.2f", F.col("risk_score").cast("double")).alias("Risk_Score"), secs("first_us").alias("First_Seen"),
        secs("last_us").alias("Last_Seen"), F.col("occurrences").cast("string").alias("Occurrences"),
        text(F.col("context")).alias("Context"), text(F.array_join("associated_ips", ";")).alias("Associated_IPs"),
        opt("techniques", text(F.array_join(F.col("techniques"), ";")) if "techniques" in have else None).alias("MITRE_Techniques"),
        opt("protocol", text(F.col("protocol")) if "protocol" in have else None).alias("Protocol"),
        opt("port", F.col("port").cast("string") if "port" in have else None).alias("Port"),
        opt("description", text(F.col("description")) if "description" in have else None).alias("Description"))
