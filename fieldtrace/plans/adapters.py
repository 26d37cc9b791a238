"""The driver tables seen as network traffic, once as DataFrames and once as SQL.

Each adapter is integer and string arithmetic only, so both sides agree to the
last bit. Sources grow with the user count, so per-key density stays constant as
the tables grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.plans.registry import table

# --------------------------------------------------------------------------- protocol events

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_PROTO = """CASE (user_id + event_id % 3) % 5 WHEN 0 THEN 'MODBUS_TCP' WHEN 1 THEN 'S7COMM' WHEN 2 THEN 'DNP3'
 WHEN 3 THEN 'IEC_104' ELSE 'ENIP' END"""
_EVENTS = f"""
SELECT event_id AS seq, {{t_us}} AS ts_us, user_id, event_type, value, {_K} AS k, {_PROTO} AS protocol,
 concat('10.1.', CAST({{u250}} % 250 AS {{text}}), '.', CAST(user_id % 250 AS {{text}})) AS src_ip,
 concat('10.2.', CAST({{u10}} % 250 AS {{text}}), '.', CAST(event_id % 3 + 1 AS {{text}})) AS dst_ip,
 CAST(40000 + user_id % 7 * 10 + event_id % 4 AS INT) AS src_port,
 CAST(CASE (user_id + event_id % 3) % 5 WHEN 0 THEN 502 WHEN 1 THEN 102 WHEN 2 THEN 20000 WHEN 3 THEN 2404 ELSE 44818 END AS INT) AS dst_port,
 concat(props, event_type) AS raw
FROM events"""
_OT = """
SELECT *,
 CAST(CASE protocol
  WHEN 'MODBUS_TCP' THEN CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 4 WHEN 'purchase' THEN 6 WHEN 'signup' THEN 16 ELSE 90 END
  WHEN 'S7COMM' THEN CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 240 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 26 ELSE 41 END
  WHEN 'DNP3' THEN CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 ELSE 18 END
  WHEN 'IEC_104' THEN CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 7 WHEN 'purchase' THEN 45 WHEN 'signup' THEN 46 ELSE 19 END
  ELSE 111 END AS INT) AS function_code,
 CASE WHEN protocol = 'S7COMM' AND event_type = 'signup' THEN 'Request Download'
  WHEN protocol = 'IEC_104' AND event_type = 'click' THEN 'STARTDT act'
  WHEN protocol = 'IEC_104' AND event_type = 'error' THEN 'STOPDT act' ELSE event_type END AS function_name,
 CASE event_type WHEN 'purchase' THEN 'WRITE' WHEN 'signup' THEN 'WRITE' WHEN 'error' THEN 'CONTROL' ELSE 'READ' END AS operation_type,
 CASE event_type WHEN 'purchase' THEN 'MEDIUM' WHEN 'signup' THEN 'HIGH' WHEN 'error' THEN 'CRITICAL' ELSE 'LOW' END AS risk_level,
 CASE WHEN protocol = 'ENIP' THEN CASE event_type WHEN 'view' THEN 'CIP=0x4C' WHEN 'click' THEN 'CIP=0x0E' WHEN 'purchase' THEN 'CIP=0x4D' WHEN 'signup' THEN 'CIP=0x05' ELSE 'CIP=0x07' END
  WHEN protocol = 'IEC_104' AND event_type IN ('click', 'error') THEN 'U-Frame' ELSE '' END AS notes,
 CAST(user_id % 4 AS INT) AS unit_id, CAST(k AS INT) AS data_address, CAST(k * 2 AS INT) AS data_count,
 concat('HR ', CAST(k % 10 AS {text})) AS target
FROM ({inner}) base"""

_SPARK = {"t_us": "(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) div 3600", "u250": "(user_id div 250)",
          "u10": "(user_id div 10)", "text": "STRING"}
_DUCK = {"t_us": "(epoch_us(ts) - 1704067200000000) // 3600", "u250": "(user_id // 250)",
         "u10": "(user_id // 10)", "text": "VARCHAR"}

EV_SQL = "ev AS (" + _OT.format(inner=_EVENTS.format(**_DUCK), text="VARCHAR") + ")"


def _over(df: DataFrame, sql: str) -> DataFrame:
    return df.sparkSession.sql(sql.replace("FROM events", "FROM {source}", 1), source=df)


def base_events(spark: SparkSession, folder: str) -> DataFrame:
    return _over(table(spark, folder, "events"), _EVENTS.format(**_SPARK))


def ot_events(spark: SparkSession, folder: str) -> DataFrame:
    """events as decoded protocol events; one hour becomes one second."""
    base = base_events(spark, folder)
    rows = spark.sql(_OT.format(inner="SELECT * FROM {base}", text="STRING"), base=base)
    details = F.struct(
        F.lit(None).cast("string").alias("op"), F.col("target").alias("target"), F.col("value").alias("value"),
        F.lit(None).cast("boolean").alias("is_request"), F.col("data_count").alias("count"),
        F.lit(None).cast("string").alias("station"), F.lit(False).alias("cyclic"),
        F.create_map(F.lit("unit"), F.col("unit_id").cast("string")).alias("extra"))
    return (rows.withColumn("raw", F.encode("raw", "UTF-8")).withColumn("details", details).drop("target")
            .withColumn("mitre", F.when(F.col("operation_type") == "READ", F.array(F.lit("T0801"), F.lit("T0802")))
                        .otherwise(F.array(F.lit("T0831"), F.lit("T0836"))))
            .withColumn("threat_score", F.when(F.col("risk_level") == "CRITICAL", 1.0)
                        .when(F.col("risk_level") == "HIGH", 0.75).when(F.col("risk_level") == "MEDIUM", 0.5)
                        .otherwise(0.25)))


# --------------------------------------------------------------------------- alerts

_ALERT = """
SELECT seq, ts_us, src_ip, dst_ip, protocol, k, user_id, event_type, value, function_code, operation_type, src_port, dst_port,
 CASE k % 12 WHEN 0 THEN 'IT_PORT_SCAN_FAST' WHEN 1 THEN 'IT_BRUTE_FORCE' WHEN 2 THEN 'HTTP_WEBSHELL'
  WHEN 3 THEN 'OT_REPLAY_ATTACK' WHEN 4 THEN 'C2_BEACON_REGULAR' WHEN 5 THEN 'DATA_EXFIL_CUMULATIVE'
  WHEN 6 THEN 'IT_LATERAL_MOVEMENT_SMB' WHEN 7 THEN 'MODBUS_WRITE_ABUSE' WHEN 8 THEN 'HTTP_SQL_INJECTION'
  WHEN 9 THEN 'OT_POLLING_DEVIATION' WHEN 10 THEN 'ARP_SPOOFING_DETECTED' ELSE 'ML_ANOMALY' END AS anomaly_type,
 CASE event_type WHEN 'view' THEN 'LOW' WHEN 'click' THEN 'MEDIUM' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
 0.5 + CAST(k % 5 AS DOUBLE) / 10 AS confidence,
 concat('s', CAST({sess} % 40 AS {text})) AS session_id,
 concat('host', CAST(k % 17 AS {text}), CASE k % 4 WHEN 0 THEN '.tk' WHEN 1 THEN '.example.com' WHEN 2 THEN '.plant.local' ELSE '.acme.net:8080' END) AS host,
 concat('/p', CAST(k % 9 AS {text}), CASE k % 7 WHEN 0 THEN '?cmd=id' WHEN 1 THEN '/../x' ELSE '' END) AS uri,
 CASE WHEN k % 3 = 0 THEN concat('payload-', CAST(k AS {text})) END AS payload
FROM {source}"""

AL_SQL = EV_SQL + ", al AS (" + _ALERT.format(source="ev", text="VARCHAR", sess="(user_id // 5)") + ")"

# techniques by alert type (fixed values of the adapter)
ALERT_TECHNIQUES = {
    "IT_PORT_SCAN_FAST": ["T1046", "T0841"], "IT_BRUTE_FORCE": ["T1110"], "HTTP_WEBSHELL": ["T1505.003", "T1059.004"],
    "OT_REPLAY_ATTACK": ["T0830", "T0855", "T0856"], "C2_BEACON_REGULAR": ["T1071", "T1573"],
    "DATA_EXFIL_CUMULATIVE": ["T1041", "T1048"], "IT_LATERAL_MOVEMENT_SMB": ["T1021.002", "T1570"],
    "MODBUS_WRITE_ABUSE": ["T0831"], "HTTP_SQL_INJECTION": ["T1190"], "OT_POLLING_DEVIATION": ["T0814", "T0815"],
    "ARP_SPOOFING_DETECTED": ["T1557.002", "T1040"], "ML_ANOMALY": ["T0999"],
}
MITRE_SQL = "mt AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{kind}', '{tech}')" for kind, techs in ALERT_TECHNIQUES.items() for tech in techs) + ") v(anomaly_type, technique))"


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """events as raw alerts of a dozen types."""
    rows = spark.sql(_ALERT.format(source="{base}", text="STRING", sess="(user_id div 5)"),
                     base=ot_events(spark, folder))
    techniques = F.create_map(*[x for kind, techs in ALERT_TECHNIQUES.items() for x in (F.lit(kind), F.array(*[F.lit(t) for t in techs]))])
    mitre = F.coalesce(F.element_at(techniques, F.col("anomaly_type")), F.array().cast("array<string>"))
    return rows.withColumn("mitre", mitre)


# --------------------------------------------------------------------------- packets and flows

_SEGMENT = """
SELECT seq, ts_us, src_ip, dst_ip, src_port, k, user_id, event_type, value,
 CAST(CASE k % 10 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 3389 WHEN 3 THEN 445 WHEN 4 THEN 139 WHEN 5 THEN 80
  WHEN 6 THEN 4444 ELSE 1000 + k END AS INT) AS dst_port,
 CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 2 WHEN 'purchase' THEN 18 WHEN 'signup' THEN 16 ELSE 4 END AS INT) AS tcp_flags,
 CAST(6 AS INT) AS ip_proto, CAST(40 + k * 11 AS INT) AS ip_len,
 concat('aa:bb:cc:00:00:0', CAST(k % 3 AS {text})) AS src_mac
FROM {source}"""

SG_SQL = EV_SQL + ", sg AS (" + _SEGMENT.format(source="ev", text="VARCHAR") + ")"


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """events as TCP segments."""
    return spark.sql(_SEGMENT.format(source="{base}", text="STRING"), base=base_events(spark, folder))


_FLOW = """
SELECT src, dst, ts_us, ROW_NUMBER() OVER (PARTITION BY src, dst, ts_us ORDER BY bytes) AS seq, bytes FROM (
SELECT concat('h', CAST(l_suppkey AS {text})) AS src, concat('d', CAST(l_partkey % 5 AS {text})) AS dst,
 {days} * 7200000000 + CAST(l_linenumber AS BIGINT) * 600000000 AS ts_us, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes
FROM {source} GROUP BY 1, 2, 3) f"""
FL_SQL = "fl AS (" + _FLOW.format(text="VARCHAR", days="date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))",
                                  source="lineitem") + ")"


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as transfers: one record per source, destination and time."""
    days = "datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01')"
    source = table(spark, folder, "lineitem")
    rows = source.groupBy(
        F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("src_ip"),
        F.concat(F.lit("d"), (F.col("l_partkey") % 5).cast("string")).alias("dst_ip"),
        F.expr(f"{days} * 7200000000L + 600000000L * l_linenumber").alias("ts_us"),
    ).agg(F.sum(F.col("l_extendedprice").cast("long")).alias("bytes"))
    return rows.withColumn("seq", F.lit(1).cast("long"))


_DNS = """
SELECT seq, ts_us, src_ip, dst_ip, CAST(CASE k % 3 WHEN 0 THEN 16 ELSE 1 END AS INT) AS qtype,
 CASE k % 4 WHEN 0 THEN concat(substr(md5(CAST(seq AS {text})), 1, 12), '.tun', CAST(user_id % 3 AS {text}), '.com')
  WHEN 1 THEN concat(md5(CAST(k AS {text})), '.', md5(CAST(k + 1 AS {text})), '.long.org')
  WHEN 2 THEN concat('www.site', CAST(k AS {text}), '.net') ELSE concat('plain', CAST(k AS {text})) END AS qname
FROM {source}"""
DN_SQL = EV_SQL + ", dn AS (" + _DNS.format(source="ev", text="VARCHAR") + ")"


def dns_queries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(_DNS.format(source="{base}", text="STRING"), base=base_events(spark, folder)).withColumn(
        "is_response", F.lit(False))


_ARP = """
SELECT seq, ts_us, src_ip AS sender_ip, concat('aa:bb:cc:00:00:0', CAST(k % 3 AS {text})) AS sender_mac,
 CASE WHEN event_type = 'view' THEN src_ip ELSE dst_ip END AS target_ip, event_type = 'view' AS is_gratuitous, CAST(1 AS INT) AS opcode
FROM {source}"""
AR_SQL = EV_SQL + ", ar AS (" + _ARP.format(source="ev", text="VARCHAR") + ")"


def arp(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(_ARP.format(source="{base}", text="STRING"), base=base_events(spark, folder))


# --------------------------------------------------------------------------- web

# attack strings planted into page requests (fixed values of the adapter)
_WEB_QUERY = """CASE page_id % 12
 WHEN 0 THEN '?id=1%27%20OR%201%3D1' WHEN 1 THEN '/../../etc/passwd' WHEN 2 THEN '/shell.php?cmd=cat%20/etc/passwd'
 WHEN 3 THEN '?url=http://169.254.169.254/latest' WHEN 4 THEN '?q={{7*7}}' WHEN 5 THEN '/backup.sql'
 WHEN 6 THEN '?next=http://evil.example' WHEN 7 THEN '/scada/login' ELSE '' END"""
_WEB = """
SELECT page_id AS seq, page_id * 250000 AS ts_us, concat('10.3.', CAST({p50} % 250 AS {text}), '.', CAST(page_id % 5 AS {text})) AS src_ip,
 '10.9.0.1' AS dst_ip, CAST(50000 + page_id % 97 AS INT) AS src_port, CAST(80 AS INT) AS dst_port,
 CASE page_id % 6 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' WHEN 2 THEN 'DELETE' ELSE 'GET' END AS method,
 regexp_extract(url, '^https?://([^/]+)', 1) AS host,
 concat(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), """ + _WEB_QUERY + """) AS uri,
 CASE page_id % 5 WHEN 0 THEN 'sqlmap/1.7' WHEN 1 THEN 'Mozilla/5.0 (X11)' WHEN 2 THEN 'gobuster/3.5' WHEN 3 THEN 'curl/8.0' ELSE 'Mozilla/5.0 (Windows NT 10.0)' END AS user_agent,
 CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'multipart/form-data; boundary=xx' ELSE 'application/x-www-form-urlencoded' END AS content_type,
 html AS body, html
FROM {source}"""
WB_SQL = "wb AS (" + _WEB.replace("{{7*7}}", "\x00").replace("{p50}", "(page_id // 50)").replace(
    "{text}", "VARCHAR").replace("{source}", "pages").replace("\x00", "{{7*7}}") + ")"


def web_requests(spark: SparkSession, folder: str) -> DataFrame:
    """pages as HTTP requests, some of them with planted attack strings."""
    sql = (_WEB.replace("{{7*7}}", "\x00").replace("{p50}", "(page_id div 50)").replace("{text}", "STRING")
           .replace("FROM {source}", "FROM {pages}").replace("\x00", "{{{{7*7}}}}"))
    rows = spark.sql(sql, pages=table(spark, folder, "pages"))
    return rows.withColumn("headers_raw", F.concat(F.lit("Host: "), "host", F.lit("\r\nUser-Agent: "), "user_agent",
                                                   F.lit("\r\nContent-Type: "), "content_type"))


_RESPONSE = """
SELECT seq, ts_us, src_ip AS client_ip, concat('10.9.0.', CAST(user_id % 3 AS {text})) AS server_ip, CAST(80 AS INT) AS server_port,
 CAST(CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 403 ELSE 404 END AS INT) AS status
FROM {source}"""
RS_SQL = EV_SQL + ", rs AS (" + _RESPONSE.format(source="ev", text="VARCHAR") + ")"


def web_responses(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(_RESPONSE.format(source="{base}", text="STRING"), base=base_events(spark, folder))


# --------------------------------------------------------------------------- history

_SESSIONS = """
SELECT concat('s', CAST(o_orderkey AS {text})) AS session_id, concat('capture_', CAST(o_custkey % 100 AS {text}), '.pcap') AS capture,
 {t} AS started_us, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 CAST(floor(o_totalprice) AS BIGINT) AS total_packets, o_custkey % 50 AS total_anomalies
FROM {source}"""
SE_SQL = "se AS (" + _SESSIONS.format(text="VARCHAR", t="epoch_us(o_orderdate)", source="orders") + ")"


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(_SESSIONS.format(text="STRING", t="unix_micros(CAST(o_orderdate AS TIMESTAMP))", source="{orders}"),
                     orders=table(spark, folder, "orders"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts as stored under a session of the history (joins to :func:`sessions`)."""
    return alerts(spark, folder)
