"""Feeds, exports and statistical outliers over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import ml
from fieldtrace.plans import adapters as ad
from fieldtrace.plans.registry import query, table
from fieldtrace.plans.sqltext import BYTE_ENTROPY
from fieldtrace.session import scratch
from fieldtrace.sources import store
from fieldtrace.sources.feeds import parse_feed
from fieldtrace.sources.store import import_documents, report_table, session_documents


@query("read_threat_feed", """SELECT lower(url) AS value, CASE page_id % 3 WHEN 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CASE page_id % 3 WHEN 0 THEN 'a, b' ELSE 'User-defined malicious domain' END AS description FROM pages WHERE page_id % 5 <> 4""")
def read_threat_feed(spark, folder):
    m = F.col("page_id") % 3
    line = F.when(F.col("page_id") % 5 == 4, F.concat(F.lit("# "), "url")).when(m == 0, F.concat("url", F.lit(" , CRITICAL, a, b"))).otherwise(F.concat(F.lit(" "), "url"))
    return parse_feed(table(spark, folder, "pages").select(line.alias("value")), "domain").drop("kind")


def _exported(spark, folder):
    alerts = ad.alerts(spark, folder).withColumn("evidence", F.create_map(F.lit("k"), F.col("k").cast("string")))
    sessions = alerts.select("session_id", F.concat(F.lit("capture-"), "session_id").alias("capture"), F.lit(0).cast("long").alias("started_us")).distinct()
    iocs = alerts.groupBy("session_id", F.lit("DOMAIN").alias("ioc_type"), F.col("host").alias("value")).agg(
        F.lit("HIGH").alias("severity"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("occurrences"))
    return session_documents(sessions, alerts, iocs)


@query("export_session", f"WITH {ad.AL_SQL} SELECT session_id, count(*) AS alerts, count(DISTINCT host) AS iocs FROM al GROUP BY 1")
def export_session(spark, folder):
    return _exported(spark, folder).select("session.session_id", F.size("anomalies").cast("long").alias("alerts"), F.size("iocs").cast("long").alias("iocs"))


@query("import_session", f"WITH {ad.AL_SQL} SELECT concat(session_id, '-import') AS session_id, anomaly_type, ts_us, CAST(k AS VARCHAR) AS k FROM al")
def import_session(spark, folder):
    _, alerts, _ = import_documents(_exported(spark, folder))
    return alerts.select("session_id", "anomaly_type", "ts_us", F.get_json_object("evidence", "$.k").alias("k"))


def _sightings(rows):
    return rows.groupBy("session_id", F.lit("DOMAIN").alias("ioc_type"), F.col("host").alias("value")).agg(
        F.lit("HIGH").alias("severity"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("occurrences"),
        F.lit(None).cast("string").alias("threat_intel"))


@query("store_anomalies", f"WITH {ad.AL_SQL} SELECT session_id, seq, anomaly_type, CAST(k AS VARCHAR) AS k FROM al")
def store_anomalies(spark, folder):
    """All alerts stored under their sessions, evidence as JSON text, and read back."""
    path = scratch(spark, "alerts")
    store.append(ad.alerts(spark, folder).select("session_id", "seq", "anomaly_type", F.create_map(F.lit("k"), F.col("k").cast("string")).alias("evidence")), path)
    return spark.read.parquet(path).select("session_id", "seq", "anomaly_type", F.get_json_object("evidence", "$.k").alias("k"))


@query("store_session", f"WITH {ad.AL_SQL} SELECT session_id, min(ts_us) AS started_us, count(*) AS alerts FROM al GROUP BY 1")
def store_session(spark, folder):
    path = scratch(spark, "sessions")
    store.append(ad.alerts(spark, folder).groupBy("session_id").agg(F.min("ts_us").alias("started_us"), F.count(F.lit(1)).alias("alerts")), path)
    return spark.read.parquet(path).select("session_id", "started_us", "alerts")


@query("store_iocs", f"WITH {ad.AL_SQL} SELECT session_id, host AS value, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS occurrences FROM al GROUP BY 1, 2")
def store_iocs(spark, folder):
    """Sightings of the alerts with even numbers are stored, those of the others merged into them in place."""
    path, rows = scratch(spark, "iocs"), ad.alerts(spark, folder)
    store.append(_sightings(rows.where("seq % 2 = 0")), path)
    store.merge_iocs(spark, _sightings(rows.where("seq % 2 = 1")), path)
    return spark.read.parquet(path).select("session_id", "value", "first_us", "last_us", "occurrences")


@query("drop_sessions", f"WITH {ad.AL_SQL} SELECT session_id, seq FROM al WHERE session_id NOT IN (SELECT session_id FROM al GROUP BY 1 HAVING max(seq) % 4 = 0) AND session_id <> 's5'")
def drop_sessions(spark, folder):
    """A part of the sessions, and one by name, deleted from a stored table."""
    path, rows = scratch(spark, "alerts"), ad.alerts(spark, folder)
    store.append(rows.select("session_id", "seq"), path)
    sessions = rows.groupBy("session_id").agg((F.max("seq") % 4).alias("started_us"))
    store.drop_sessions(spark, sessions, path, older_than_us=1, ids=["s5"])
    return spark.read.schema("seq long, session_id string").parquet(path).select("session_id", "seq")


@query("export_iocs_json", f"""WITH {ad.AL_SQL} SELECT 'URL' AS category, concat('http://', host, uri) AS value, count(*) AS occurrences, min(ts_us) AS first_us FROM al GROUP BY 2""")
def export_iocs_json(spark, folder):
    from fieldtrace.operators.ioc import ioc_urls
    path = scratch(spark, "json")
    store.export_iocs_json(ioc_urls(ad.alerts(spark, folder)), path)
    return spark.read.schema("category string, value string, occurrences long, first_us long").json(path).select("category", "value", "occurrences", "first_us")


@query("report_tables", f"WITH {ad.AL_SQL} SELECT seq, host, concat('[\"', src_ip, '\"]') AS sources FROM al ORDER BY ts_us, seq LIMIT 1000")
def report_tables(spark, folder):
    rows = ad.alerts(spark, folder).select("ts_us", "seq", "host", F.array("src_ip").alias("sources"))
    return report_table(rows, 1000).select("seq", "host", "sources")


@query("robust_group_outlier", f"""WITH {ad.EV_SQL}, m AS (SELECT protocol, quantile_cont(-value, 0.5) AS med FROM ev GROUP BY 1), d AS (SELECT protocol, med, quantile_cont(abs(-value - med), 0.5) AS mad FROM ev JOIN m USING (protocol) GROUP BY 1, 2)
SELECT seq, protocol, round(-value, 4) AS score FROM ev JOIN d USING (protocol) WHERE -value < med - greatest(0.05, 4.0 * mad)""")
def robust_group_outlier(spark, folder):
    rows = ad.ot_events(spark, folder).withColumn("score", -F.col("value"))
    return ml.robust_group_outlier(rows, "score", ["protocol"]).select("seq", "protocol", F.round("score", 4).alias("score"))


@query("ml_outlier")
def ml_outlier(spark, folder):
    from fieldtrace.functions.text import shannon_entropy
    from fieldtrace.operators.decode import flow_timing_features
    events = ad.ot_events(spark, folder).withColumn("payload_byte", F.col("k").cast("int")).withColumn("payload_entropy", shannon_entropy("raw"))
    return ml.ml_outlier(flow_timing_features(events)).select("ts_us", "seq", "src_ip", "dst_ip", "protocol", "severity", "confidence")


@query("high_entropy_payload", f"""SELECT doc_id AS seq, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) > 20 AND {BYTE_ENTROPY.format(x='text')} > 4.2""")
def high_entropy_payload(spark, folder):
    from fieldtrace.functions.text import shannon_entropy
    from fieldtrace.operators.ot import high_entropy_payload as detect
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("ts_us"), F.col("doc_id").alias("seq"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"), F.lit("MODBUS_TCP").alias("protocol"),
        F.encode("text", "UTF-8").alias("raw"))
    return detect(rows.withColumn("payload_entropy", shannon_entropy("raw")), min_entropy=4.2).select(
        "seq", F.col("evidence")["payload_size"].cast("long").alias("size"))
