"""Rules, indicators, feeds, lookups, history and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace import dims
from fieldtrace.functions import net, scalar, text
from fieldtrace.operators import alerts as al
from fieldtrace.operators import events as ev
from fieldtrace.operators import history as hi
from fieldtrace.operators import ioc
from fieldtrace.operators import rules as ru
from fieldtrace.plans import adapters as ad
from fieldtrace.plans import alert_queries as aq
from fieldtrace.plans import sqltext as st
from fieldtrace.plans.registry import query, table

RULES = [
    {"id": "R-1", "name": "Modbus write", "severity": "HIGH", "mitre": ["T0836"],
     "match": {"protocol": "modbus-tcp", "op": ["WRITE", "SETPOINT"], "src_ip": ["!10.1.0.0/28"], "is_request": True}, "cooldown_seconds": 60},
    {"id": "R-2", "name": "Critical control", "severity": "CRITICAL", "cooldown_seconds": 100,
     "match": {"risk_level": "CRITICAL", "value_gt": 50, "dst_port": ["100-600", "!502"]}},
    {"id": "R-3", "name": "Burst of writes", "severity": "MEDIUM", "match": {"op": "WRITE*"}, "cooldown_seconds": 0,
     "threshold": {"count": 3, "seconds": 120, "group_by": ["src_ip", "protocol"]}},
    {"id": "R-4", "name": "Slow repeats", "match": {"target": "HR [0-4]$", "unit_id": [1, 2]}, "cooldown_seconds": 90,
     "threshold": {"count": 2, "seconds": 60, "group_by": ["dst_ip"]}},
    {"id": "R-5", "name": "Off", "match": {}, "enabled": False},
]
M1 = """protocol = 'MODBUS_TCP' AND operation_type = 'WRITE' AND NOT (user_id % 250 < 16 AND user_id < 250) AND src_port > dst_port"""
M2 = "risk_level = 'CRITICAL' AND value > 50 AND dst_port BETWEEN 100 AND 600 AND dst_port <> 502"
M3 = "operation_type = 'WRITE'"
M4 = "k % 10 <= 4 AND unit_id IN (1, 2)"
MATCH_SQL = f"""{ad.EV_SQL}, mr AS (
SELECT *, 'R-1' AS rule_id, concat(src_ip, '|', dst_ip) AS rule_group FROM ev WHERE {M1}
UNION ALL SELECT *, 'R-2', concat(src_ip, '|', dst_ip) FROM ev WHERE {M2}
UNION ALL SELECT *, 'R-3', concat(src_ip, '|', protocol) FROM ev WHERE {M3}
UNION ALL SELECT *, 'R-4', dst_ip FROM ev WHERE {M4})"""


def trip_sql(rule, count, window_us, name):
    """Resetting threshold as a fold: pending times and fired times per group."""
    return f"""{name}_l AS (SELECT rule_id, rule_group, list_reduce(list_transform(list(ts_us ORDER BY ts_us, seq), lambda t: [[t], []::BIGINT[]]),
 lambda a, x: CASE WHEN len(list_filter(list_concat(a[1], x[1]), lambda p: p >= x[1][1] - {window_us})) >= {count} THEN [[]::BIGINT[], list_append(a[2], x[1][1])]
  ELSE [list_filter(list_concat(a[1], x[1]), lambda p: p >= x[1][1] - {window_us}), a[2]] END, [[]::BIGINT[], []::BIGINT[]]) AS s FROM mr WHERE rule_id = '{rule}' GROUP BY ALL),
{name} AS (SELECT mr.* FROM mr JOIN (SELECT rule_id, rule_group, unnest(s[2]) AS ts_us FROM {name}_l) f USING (rule_id, rule_group, ts_us))"""


@query("rule_predicate", f"WITH {MATCH_SQL} SELECT seq, rule_id, rule_group FROM mr")
def rule_predicate(spark, folder):
    return ru.matched_rules(ad.ot_events(spark, folder), RULES[:4]).select("seq", "rule_id", "rule_group")


@query("rule_cooldown", f"WITH {MATCH_SQL}, m1 AS (SELECT * FROM mr WHERE rule_id = 'R-1'), {st.kept('m1', 'rule_id, rule_group', 60_000_000)} SELECT seq, rule_group FROM kept")
def rule_cooldown(spark, folder):
    matches = ru.matched_rules(ad.ot_events(spark, folder), RULES[:1])
    return ru.rule_cooldown(matches, 60.0).select("seq", "rule_group")


@query("rule_threshold", f"WITH {MATCH_SQL}, {trip_sql('R-3', 3, 120_000_000, 't3')} SELECT seq, rule_group FROM t3")
def rule_threshold(spark, folder):
    matches = ru.matched_rules(ad.ot_events(spark, folder), RULES[2:3])
    return ru.rule_threshold(matches, {"R-3": (3, 120.0)}).select("seq", "rule_group")


@query("evaluate_rules", f"""WITH {MATCH_SQL}, {trip_sql('R-3', 3, 120_000_000, 't3')}, {trip_sql('R-4', 2, 60_000_000, 't4')},
m1 AS (SELECT * FROM mr WHERE rule_id = 'R-1'), m2 AS (SELECT * FROM mr WHERE rule_id = 'R-2'),
{st.kept('m1', 'rule_id, rule_group', 60_000_000, name='k1')}, {st.kept('m2', 'rule_id, rule_group', 100_000_000, name='k2')}, {st.kept('t4', 'rule_id, rule_group', 90_000_000, name='k4')},
u AS (SELECT seq, rule_id FROM k1 UNION ALL SELECT seq, rule_id FROM k2 UNION ALL SELECT seq, rule_id FROM t3 UNION ALL SELECT seq, rule_id FROM k4)
SELECT seq, concat('CUSTOM_', replace(rule_id, '-', '_')) AS anomaly_type, CASE rule_id WHEN 'R-1' THEN 'HIGH' WHEN 'R-2' THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity FROM u""")
def evaluate_rules(spark, folder):
    return ru.evaluate_rules(ad.ot_events(spark, folder), RULES).select("seq", "anomaly_type", "severity")


# --------------------------------------------------------------------------- indicators

@query("ioc_ips", f"""WITH {aq.RISK_SQL}, s AS (SELECT ip, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS occurrences FROM v GROUP BY ip)
SELECT rs.ip AS value, CASE WHEN risk_score >= 0.9 THEN 'CRITICAL' WHEN risk_score >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, first_us, last_us, occurrences FROM rs JOIN s USING (ip) WHERE risk_score >= 0.1""")
def ioc_ips(spark, folder):
    v = aq.violations(spark, folder)
    return ioc.ioc_ips(al.ip_risk_score(v, decay_s=60), v, min_risk=0.1).select("value", "severity", "first_us", "last_us", "occurrences")


@query("ioc_hashes", f"""WITH {ad.AL_SQL}, d AS (SELECT sha256(text) AS sha256, 0 AS s, doc_id AS ts_us, doc_id AS seq, lang AS kind FROM documents
 UNION ALL SELECT sha256(payload), 1, ts_us, seq, anomaly_type FROM al WHERE payload IS NOT NULL)
SELECT sha256 AS value, min_by(kind, (s, ts_us, seq)) AS context, min_by(ts_us, (s, ts_us, seq)) AS first_us FROM d GROUP BY sha256""")
def ioc_hashes(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("ts_us"), F.col("doc_id").alias("seq"), text.sha256(F.encode("text", "UTF-8")).alias("sha256"),
        F.col("lang").alias("kind"), F.lit("HIGH").alias("severity"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"))
    found = ad.alerts(spark, folder).where("payload IS NOT NULL").select(
        "ts_us", "seq", text.sha256(F.encode("payload", "UTF-8")).alias("sha256"), F.col("anomaly_type").alias("kind"), "severity", "src_ip", "dst_ip")
    return ioc.ioc_hashes(docs, found).select("value", "context", "first_us")


@query("ioc_mitre", f"""WITH {ad.AL_SQL}, {ad.MITRE_SQL}, u AS (SELECT technique AS value, ts_us, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) AS sr, anomaly_type, src_ip, dst_ip FROM al JOIN mt USING (anomaly_type))
SELECT value, count(*) AS occurrences, min(ts_us) AS first_us, max(ts_us) AS last_us, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(sr)] AS severity,
 array_to_string(list_sort(list(DISTINCT anomaly_type))[1:5], ', ') AS context,
 (SELECT array_to_string(list_sort(list(ip))[1:10], ',') FROM (SELECT src_ip AS ip FROM u w WHERE w.value = u.value UNION SELECT dst_ip FROM u w WHERE w.value = u.value)) AS ips FROM u GROUP BY value""")
def ioc_mitre(spark, folder):
    return ioc.ioc_mitre(ad.alerts(spark, folder)).select("value", "occurrences", "first_us", "last_us", "severity", "context",
                                                          F.array_join("associated_ips", ",").alias("ips"))


@query("ioc_domains", f"""WITH {ad.AL_SQL}, d AS (SELECT * EXCLUDE (value), split_part(host, ':', 1) AS value FROM al WHERE regexp_matches(split_part(host, ':', 1), '^([a-zA-Z0-9]([a-zA-Z0-9\\-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}'))
SELECT value, count(*) AS occurrences, min(ts_us) AS first_us, max(ts_us) AS last_us,
 coalesce(arg_max(severity, (ts_us, seq)) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')), CASE WHEN value LIKE '%.tk' THEN 'MEDIUM' ELSE 'LOW' END) AS severity FROM d GROUP BY value""")
def ioc_domains(spark, folder):
    return ioc.ioc_domains(ad.alerts(spark, folder)).select("value", "occurrences", "first_us", "last_us", "severity")


@query("ioc_urls", f"""WITH {ad.AL_SQL}, d AS (SELECT * EXCLUDE (value), concat('http://', host, uri) AS value FROM al),
g AS (SELECT value, count(*) AS occurrences, min(ts_us) AS first_us, max(ts_us) AS last_us, arg_max(severity, (ts_us, seq)) AS s FROM d WHERE length(value) < 500 GROUP BY value)
SELECT value, occurrences, first_us, last_us, CASE WHEN (contains(value, 'cmd=') OR contains(value, '../')) AND s IN ('LOW', 'MEDIUM') THEN 'HIGH' ELSE s END AS severity FROM g""")
def ioc_urls(spark, folder):
    return ioc.ioc_urls(ad.alerts(spark, folder)).select("value", "occurrences", "first_us", "last_us", "severity")


def category_sql():
    def test(word):
        return "(" + " AND ".join(f"contains(anomaly_type, '{p}')" for p in word.split("+")) + ")"
    return "CASE " + " ".join(f"WHEN {' OR '.join(test(w) for w in words)} THEN '{n}'" for n, words in ioc.CATEGORIES) + " ELSE 'OTHER' END"


@query("ioc_by_attack", f"WITH {ad.AL_SQL} SELECT {category_sql()} AS category, src_ip, count(*) AS occurrences, min(ts_us) AS first_us, max(ts_us) AS last_us, min_by(severity, (ts_us, seq)) AS severity FROM al GROUP BY 1, 2")
def ioc_by_attack(spark, folder):
    return ioc.ioc_by_attack(ad.alerts(spark, folder))


# feeds derived from the tables: every third supplier host, every fifth page's parent domain, every tenth document
FEED_SQL = f"""{ad.EV_SQL}, fd AS (SELECT DISTINCT 'ip' AS kind, src_ip AS value, CASE WHEN user_id % 2 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM ev WHERE user_id % 3 = 0
 UNION SELECT 'domain', split_part(h, '.', -3) || '.' || split_part(h, '.', -2) || '.' || split_part(h, '.', -1), 'HIGH' FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages WHERE page_id % 5 = 0)
 UNION SELECT 'hash', sha256(text), 'CRITICAL' FROM documents WHERE doc_id % 10 = 0)"""


def feeds(spark, folder):
    ips = ad.ot_events(spark, folder).where("user_id % 3 = 0").select(
        F.lit("ip").alias("kind"), F.col("src_ip").alias("value"),
        F.when(F.col("user_id") % 2 == 0, "CRITICAL").otherwise("HIGH").alias("severity"), F.lit("feed").alias("description")).distinct()
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    domains = table(spark, folder, "pages").where("page_id % 5 = 0").select(
        F.lit("domain").alias("kind"), F.array_join(F.slice(F.split(host, "\\."), -3, 3), ".").alias("value"),
        F.lit("HIGH").alias("severity"), F.lit("feed").alias("description")).distinct()
    hashes = table(spark, folder, "documents").where("doc_id % 10 = 0").select(
        F.lit("hash").alias("kind"), F.sha2(F.encode("text", "UTF-8"), 256).alias("value"), F.lit("CRITICAL").alias("severity"),
        F.lit("feed").alias("description")).distinct()
    return ips.union(domains).union(hashes)


@query("match_feed_ip", f"WITH {FEED_SQL} SELECT seq, src_ip, fd.severity AS feed_severity FROM ev JOIN fd ON fd.kind = 'ip' AND fd.value = ev.src_ip")
def match_feed_ip(spark, folder):
    return ioc.match_feed(ad.ot_events(spark, folder), "src_ip", feeds(spark, folder), "ip").select("seq", "src_ip", "feed_severity")


@query("match_feed_hash", f"WITH {FEED_SQL} SELECT doc_id, fd.severity AS feed_severity FROM documents JOIN fd ON fd.kind = 'hash' AND fd.value = sha256(text)")
def match_feed_hash(spark, folder):
    docs = table(spark, folder, "documents").withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256))
    return ioc.match_feed(docs, "h", feeds(spark, folder), "hash").select("doc_id", "feed_severity")


@query("match_feed_domain", f"""WITH {FEED_SQL}, p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages)
SELECT page_id, fd.value AS matched FROM p JOIN fd ON fd.kind = 'domain' AND (h = fd.value OR ends_with(h, '.' || fd.value))
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(fd.value) DESC) = 1""")
def match_feed_domain(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("h"))
    return ioc.match_feed(pages, "h", feeds(spark, folder), "domain").select("page_id", "matched")


@query("enrich_anomalies", f"""WITH {FEED_SQL}, al AS ({ad._ALERT.format(source='ev', text='VARCHAR', sess='(user_id // 5)')})
SELECT seq, array_to_string(list_filter([s.value, d.value], lambda x: x IS NOT NULL), ',') AS findings FROM al
LEFT JOIN fd s ON s.kind = 'ip' AND s.value = src_ip LEFT JOIN fd d ON d.kind = 'ip' AND d.value = dst_ip WHERE s.value IS NOT NULL OR d.value IS NOT NULL""")
def enrich_anomalies(spark, folder):
    rows = ioc.enrich_anomalies(ad.alerts(spark, folder), feeds(spark, folder))
    return rows.where(F.size("findings") > 0).select("seq", F.array_join(F.transform("findings", lambda f: f["value"]), ",").alias("findings"))


@query("builtin_indicators", "WITH " + ad.DN_SQL + ", b AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v, _, _ in ioc.BUILTIN_INDICATORS) + """) v(kind, value)),
seen AS (SELECT 'domain' AS kind, qname AS value FROM dn UNION ALL SELECT 'domain', regexp_extract(url, '^https?://([^/:?#]+)', 1) FROM pages UNION ALL SELECT 'hash', sha1(text) FROM documents UNION ALL SELECT 'hash', sha256(text) FROM documents
 UNION ALL SELECT kind, value FROM b, (SELECT 1 FROM documents WHERE doc_id % 100 = 7) d)
SELECT b.kind, b.value, count(s.value) AS sightings FROM b LEFT JOIN seen s ON s.kind = b.kind AND s.value = b.value GROUP BY 1, 2""")
def builtin_indicators(spark, folder):
    """How often the built-in indicators occur as names asked for, hosts of pages and hashes of documents; each is planted once per hundred documents."""
    docs, known = table(spark, folder, "documents"), ioc.builtin_indicators(spark).select("kind", "value")
    kind = lambda name, value: (F.lit(name).alias("kind"), value.alias("value"))
    seen = (ad.dns_queries(spark, folder).select(*kind("domain", F.col("qname")))
            .unionByName(table(spark, folder, "pages").select(*kind("domain", F.regexp_extract("url", "^https?://([^/:?#]+)", 1))))
            .unionByName(docs.select(*kind("hash", F.sha1("text")))).unionByName(docs.select(*kind("hash", F.sha2("text", 256))))
            .unionByName(docs.where("doc_id % 100 = 7").select(F.explode(F.array(*[F.struct(*kind(k, F.lit(v))) for k, v, _, _ in ioc.BUILTIN_INDICATORS])).alias("i")).select("i.*")))
    return ioc.builtin_sightings(seen).select("kind", "value", "sightings")


@query("watchlist_upsert", f"""WITH {ad.AL_SQL}, w AS (SELECT DISTINCT 'DOMAIN' AS ioc_type, host AS value, 5 AS hit_count FROM al WHERE k % 2 = 0), e AS (SELECT host AS value, count(*) AS n FROM al WHERE k % 3 = 0 GROUP BY 1)
SELECT coalesce(w.value, e.value) AS value, CAST(CASE WHEN w.value IS NOT NULL THEN hit_count + coalesce(n, 0) ELSE n - 1 END AS BIGINT) AS hit_count FROM w FULL JOIN e USING (value)""")
def watchlist_upsert(spark, folder):
    rows = ad.alerts(spark, folder)
    watch = rows.where("k % 2 = 0").select(F.lit("DOMAIN").alias("ioc_type"), F.col("host").alias("value"), F.lit("HIGH").alias("severity"),
                                           F.lit(5).cast("long").alias("hit_count"), F.lit(0).cast("long").alias("last_seen_us"),
                                           F.lit(True).alias("is_active")).distinct()
    entries = rows.where("k % 3 = 0").select(F.lit("DOMAIN").alias("ioc_type"), F.col("host").alias("value"), F.lit("HIGH").alias("severity"))
    return ioc.watchlist_upsert(watch, entries, 1).select("value", "hit_count")


@query("watchlist_hits", f"""WITH {ad.AL_SQL} SELECT host AS value, count(*) AS hits FROM al WHERE host IN (SELECT host FROM al WHERE k % 8 = 0) GROUP BY 1""")
def watchlist_hits(spark, folder):
    rows = ad.alerts(spark, folder)
    watch = rows.where("k % 8 = 0").select(F.lit("DOMAIN").alias("ioc_type"), F.col("host").alias("value"), F.lit("HIGH").alias("severity"), F.lit(True).alias("is_active")).distinct()
    return ioc.watchlist_hits(watch, rows.select(F.lit("DOMAIN").alias("ioc_type"), F.col("host").alias("value"))).select("value", "hits")


# --------------------------------------------------------------------------- lookups

@query("classify_alert", f"WITH {ad.AL_SQL} SELECT anomaly_type, " + aq._case(dims.ALERT_CLASSES, "anomaly_type").replace(" END", " ELSE 'INFORMATIONAL' END") + " AS class, count(*) AS n FROM al GROUP BY ALL")
def classify_alert(spark, folder):
    return ad.alerts(spark, folder).groupBy("anomaly_type", dims.classify_alert(F.col("anomaly_type")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("explanation_join", f"""WITH {ad.AL_SQL}, e AS (SELECT anomaly_type AS attack_type, concat('About ', lower(anomaly_type)) AS summary FROM al WHERE k % 2 = 0 GROUP BY 1)
SELECT seq, anomaly_type, summary FROM al LEFT JOIN e ON attack_type = anomaly_type""")
def explanation_join(spark, folder):
    rows = ad.alerts(spark, folder)
    prose = rows.where("k % 2 = 0").select(F.col("anomaly_type").alias("attack_type"), F.concat(F.lit("About "), F.lower("anomaly_type")).alias("summary")).distinct()
    return dims.explanation_join(rows, prose).select("seq", "anomaly_type", "summary")


@query("remediation_join", f"WITH {ad.AL_SQL} SELECT seq, " + aq._case([(t[0], t[1]) for t in dims.REMEDIATION[:-1]], "anomaly_type").replace(" END", " ELSE 'DEFAULT' END") + " AS template FROM al")
def remediation_join(spark, folder):
    return dims.remediation_join(ad.alerts(spark, folder)).select("seq", "template")


@query("suspicious_port", f"""WITH {ad.SG_SQL} SELECT seq, dst_port, CASE WHEN dst_port IN (4444, 23) THEN 'CRITICAL' ELSE 'HIGH' END AS port_severity FROM sg WHERE dst_port IN (22, 23, 3389, 445, 139, 4444)""")
def suspicious_port(spark, folder):
    return dims.suspicious_port(ad.segments(spark, folder)).select("seq", "dst_port", "port_severity")


TACTIC_SQL = "td AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{t}', '{x}')" for m, tab in (("ICS", dims.ICS_TACTICS), ("Enterprise", dims.ENTERPRISE_TACTICS)) for t, ids in tab.items() for x in ids) + ") v(matrix, tactic, technique))"


@query("mitre_matrix", f"""WITH {ad.AL_SQL}, {ad.MITRE_SQL}, {TACTIC_SQL}, c AS (SELECT technique, count(*) AS n FROM al JOIN mt USING (anomaly_type) GROUP BY 1)
SELECT matrix, tactic, technique, n FROM c JOIN td USING (technique) UNION ALL SELECT 'Other', 'Other Detected', technique, n FROM c WHERE NOT contains(technique, '.') AND technique NOT IN (SELECT technique FROM td)""")
def mitre_matrix(spark, folder):
    return dims.mitre_matrix(ad.alerts(spark, folder))


@query("decode_function_dim", f"""WITH {ad.EV_SQL} SELECT seq, CASE function_code WHEN 3 THEN 'Read Holding Registers' WHEN 4 THEN 'Read Input Registers' WHEN 6 THEN 'Write Single Register' WHEN 16 THEN 'Write Multiple Registers' ELSE 'Firmware Update' END AS function_name,
 CASE WHEN function_code IN (3, 4) THEN 'READ' WHEN function_code = 90 THEN 'CONTROL' ELSE 'WRITE' END AS operation_type FROM ev WHERE protocol = 'MODBUS_TCP'""")
def decode_function_dim(spark, folder):
    rows = ad.ot_events(spark, folder).where("protocol = 'MODBUS_TCP'").select("seq", "function_code")
    return dims.decode_function_dim(rows, "MODBUS_TCP").select("seq", "function_name", "operation_type")


# --------------------------------------------------------------------------- event helpers

@query("canonical_op", f"WITH {ad.EV_SQL} SELECT seq, operation_type AS op, src_port > dst_port AND dst_port < 49152 AS is_req, operation_type <> 'READ' AS dangerous, operation_type = 'WRITE' AS write_like, target FROM ev")
def canonical_op(spark, folder):
    return ev.enrich(ad.ot_events(spark, folder)).select("seq", "op", "is_req", "dangerous", "write_like", "target")


@query("risk_to_threat_score", f"WITH {ad.EV_SQL} SELECT risk_level, CASE risk_level WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.75 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END::DOUBLE AS score, count(*) AS n FROM ev GROUP BY 1, 2")
def risk_to_threat_score(spark, folder):
    return ad.ot_events(spark, folder).groupBy("risk_level", ev.threat_score(F.col("risk_level")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("flow_timing_features", f"""WITH {ad.EV_SQL}, t AS (SELECT *, (ts_us - lag(ts_us) OVER w) / 1e6 AS dt, abs(k - lag(k) OVER w) AS dv FROM ev WINDOW w AS (PARTITION BY src_ip, dst_ip, function_code ORDER BY ts_us, seq))
SELECT seq, CAST(round(coalesce(dt, 0) * 1e6) AS BIGINT) AS time_since_last, round(CASE WHEN dt > 0 THEN dv / dt ELSE 0 END, 2) AS payload_change_rate FROM t""")
def flow_timing_features(spark, folder):
    from fieldtrace.operators.decode import flow_timing_features as features
    rows = ad.ot_events(spark, folder).withColumn("payload_byte", F.col("k").cast("int"))
    return features(rows).select("seq", F.round(F.col("time_since_last") * 1e6).cast("long").alias("time_since_last"), F.round("payload_change_rate", 2).alias("payload_change_rate"))


# --------------------------------------------------------------------------- history

SE = ad.SE_SQL
CUT = 852076800000000   # 1997-01-01
HIST = f"{ad.AL_SQL}, {SE}"


@query("search_alerts", f"WITH {ad.AL_SQL} SELECT seq, ts_us, src_ip FROM al WHERE severity = 'CRITICAL' AND anomaly_type = 'HTTP_WEBSHELL' AND ts_us BETWEEN 100000000 AND 600000000 ORDER BY ts_us DESC, seq DESC LIMIT 100")
def search_alerts(spark, folder):
    return hi.search_alerts(ad.alerts(spark, folder), severity="CRITICAL", anomaly_type="HTTP_WEBSHELL", start_us=100_000_000,
                            end_us=600_000_000, limit=100).select("seq", "ts_us", "src_ip")


@query("history_statistics", f"WITH {SE} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, CAST(sum(total_packets) AS BIGINT) AS total_packets, CAST(sum(total_anomalies) AS BIGINT) AS total_anomalies FROM se WHERE started_us >= {CUT}")
def history_statistics(spark, folder):
    return hi.session_totals(ad.sessions(spark, folder), CUT)


@query("history_types", f"WITH {HIST} SELECT anomaly_type, count(*) AS count FROM al JOIN se USING (session_id) WHERE started_us >= {CUT} GROUP BY 1")
def history_types(spark, folder):
    return hi.distribution(ad.alerts(spark, folder), ad.sessions(spark, folder), CUT, "anomaly_type")


@query("history_top_sources", f"WITH {HIST} SELECT src_ip, count(*) AS count FROM al JOIN se USING (session_id) WHERE started_us >= {CUT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def history_top_sources(spark, folder):
    return hi.top_sources(ad.alerts(spark, folder), ad.sessions(spark, folder), CUT)


IOC_SQL = f"{HIST}, io AS (SELECT session_id, 'DOMAIN' AS ioc_type, host AS value, count(*) AS occurrences FROM al GROUP BY ALL)"


def stored_iocs(spark, folder):
    return ad.alerts(spark, folder).groupBy("session_id", F.lit("DOMAIN").alias("ioc_type"), F.col("host").alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))


@query("history_ioc_types", f"WITH {IOC_SQL} SELECT ioc_type, count(*) AS \"unique\", CAST(sum(occurrences) AS BIGINT) AS total_occurrences FROM io JOIN se USING (session_id) WHERE started_us >= {CUT} GROUP BY 1")
def history_ioc_types(spark, folder):
    return hi.ioc_types(stored_iocs(spark, folder), ad.sessions(spark, folder), CUT)


TREND = """count(*) AS total_anomalies, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
 count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low"""
TIMED = "tm AS (SELECT * REPLACE (ts_us * 43200 AS ts_us) FROM al)"


def _spread(spark, folder):
    return ad.alerts(spark, folder).withColumn("ts_us", F.col("ts_us") * 43200)


@query("attack_trends", f"WITH {ad.AL_SQL}, {TIMED} SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS period, {TREND} FROM tm GROUP BY 1")
def attack_trends(spark, folder):
    return hi.attack_trends(_spread(spark, folder))


@query("attack_trends_week", f"WITH {ad.AL_SQL}, {TIMED} SELECT strftime(make_timestamp(ts_us), '%Y-%W') AS period, {TREND} FROM tm GROUP BY 1")
def attack_trends_week(spark, folder):
    return hi.attack_trends(_spread(spark, folder), "week")


@query("attack_trends_hour", f"WITH {ad.AL_SQL}, {TIMED} SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d %H:00') AS period, {TREND} FROM tm GROUP BY 1")
def attack_trends_hour(spark, folder):
    return hi.attack_trends(_spread(spark, folder), "hour")


@query("ip_history", f"WITH {ad.AL_SQL} SELECT anomaly_type, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS total FROM al WHERE src_ip = '10.2.0.1' OR dst_ip = '10.2.0.1' GROUP BY 1")
def ip_history(spark, folder):
    return hi.ip_history(ad.alerts(spark, folder), "10.2.0.1")


@query("ip_sessions", f"WITH {HIST} SELECT session_id, capture, started_us FROM se WHERE session_id IN (SELECT session_id FROM al WHERE src_ip = '10.2.1.1' OR dst_ip = '10.2.1.1') ORDER BY started_us DESC, session_id LIMIT 10")
def ip_sessions(spark, folder):
    return hi.ip_sessions(ad.alerts(spark, folder), ad.sessions(spark, folder), "10.2.1.1")


@query("get_iocs", f"WITH {IOC_SQL} SELECT value, occurrences FROM io WHERE session_id = 's3' ORDER BY occurrences DESC, value LIMIT 1000")
def get_iocs(spark, folder):
    return hi.get_iocs(stored_iocs(spark, folder), session_id="s3").select("value", "occurrences")


@query("search_iocs", f"WITH {IOC_SQL} SELECT session_id, value, occurrences, capture FROM io JOIN se USING (session_id) WHERE value LIKE '%host1_.tk%' ORDER BY occurrences DESC, value, session_id LIMIT 100")
def search_iocs(spark, folder):
    return hi.search_iocs(stored_iocs(spark, folder), ad.sessions(spark, folder), "host1_.tk").select("session_id", "value", "occurrences", "capture")


@query("list_sessions", f"WITH {SE} SELECT session_id, capture, started_us FROM se WHERE contains(capture, 'capture_7') AND started_us >= {CUT} ORDER BY started_us DESC, session_id LIMIT 500")
def list_sessions(spark, folder):
    return hi.list_sessions(ad.sessions(spark, folder), "capture_7", CUT).select("session_id", "capture", "started_us")


@query("session_overview", f"""WITH {IOC_SQL}, tt AS (SELECT session_id, anomaly_type, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, anomaly_type) AS r FROM al GROUP BY 1, 2),
tp AS (SELECT session_id, string_agg(anomaly_type, ',' ORDER BY r) AS top_types FROM tt WHERE r <= 8 GROUP BY 1),
sv AS (SELECT session_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM al GROUP BY 1), ic AS (SELECT session_id, count(*) AS ioc_count FROM io GROUP BY 1)
SELECT se.session_id, capture, coalesce(critical, 0) AS critical, coalesce(top_types, '') AS top_types, coalesce(ioc_count, 0) AS ioc_count FROM se LEFT JOIN tp USING (session_id) LEFT JOIN sv USING (session_id) LEFT JOIN ic USING (session_id)""")
def session_overview(spark, folder):
    rows = hi.session_overview(ad.sessions(spark, folder), ad.alerts(spark, folder), stored_iocs(spark, folder))
    return rows.select("session_id", "capture", F.coalesce(F.col("severity")["CRITICAL"], F.lit(0)).alias("critical"),
                       F.coalesce(F.array_join(F.transform("top_types", lambda t: t["anomaly_type"]), ","), F.lit("")).alias("top_types"), "ioc_count")


@query("compare_sessions", f"""WITH {ad.AL_SQL}, c AS (SELECT concat(anomaly_type, '/', severity) AS anomaly_type, count(*) FILTER (WHERE session_id = 's1') AS old_n, count(*) FILTER (WHERE session_id = 's2') AS new_n FROM al WHERE session_id IN ('s1', 's2') GROUP BY 1)
SELECT *, CASE WHEN old_n = 0 THEN 'new' WHEN new_n = 0 THEN 'resolved' ELSE 'changed' END AS status FROM c WHERE old_n <> new_n""")
def compare_sessions(spark, folder):
    rows = ad.alerts(spark, folder).withColumn("anomaly_type", F.concat_ws("/", "anomaly_type", "severity"))
    return hi.compare_sessions(rows, "s1", "s2")


@query("compare_iocs", f"WITH {IOC_SQL}, a AS (SELECT value FROM io WHERE session_id = 's1'), b AS (SELECT value FROM io WHERE session_id = 's2') SELECT value, 'gone' AS status FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT value, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def compare_iocs(spark, folder):
    return hi.compare_iocs(stored_iocs(spark, folder), "s1", "s2").select("value", "status")


@query("retention", f"WITH {HIST} SELECT seq, session_id FROM al WHERE session_id NOT IN (SELECT session_id FROM se WHERE started_us < {CUT} OR session_id = 's5')")
def retention(spark, folder):
    return hi.retained(ad.alerts(spark, folder), ad.sessions(spark, folder), older_than_us=CUT, ids=["s5"]).select("seq", "session_id")


@query("upsert_ioc", f"""WITH {ad.AL_SQL}, u AS (SELECT session_id, host AS value, ts_us, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS nw, severity, CASE WHEN k % 3 = 0 THEN concat('ti', CAST(k AS VARCHAR)) END AS ti FROM al)
SELECT session_id, value, count(*) AS occurrences, min(ts_us) AS first_us, max(ts_us) AS last_us, max(CASE WHEN ti IS NOT NULL THEN (nw, ts_us, ti) END)[3] AS threat_intel FROM u GROUP BY 1, 2""")
def upsert_ioc(spark, folder):
    rows = ad.alerts(spark, folder).select(
        "session_id", F.lit("DOMAIN").alias("ioc_type"), F.col("host").alias("value"), "severity", F.col("ts_us").alias("first_us"),
        F.col("ts_us").alias("last_us"), F.lit(1).cast("long").alias("occurrences"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("ti"), F.col("k").cast("string"))).alias("threat_intel"), "event_type")
    old, new = rows.where("event_type = 'view'").drop("event_type"), rows.where("event_type <> 'view'").drop("event_type")
    return hi.upsert_ioc(old, new).select("session_id", "value", "occurrences", "first_us", "last_us", "threat_intel")


# --------------------------------------------------------------------------- summaries

@query("capture_summary", f"""WITH {ad.AL_SQL} SELECT count(*) AS ot_events, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT protocol) AS protocols, count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS high_risk_events,
 (SELECT count(*) FROM al) AS anomalies, (SELECT count(*) FROM al WHERE severity = 'CRITICAL') AS critical, max(ts_us) - min(ts_us) AS duration_us FROM ev""")
def capture_summary(spark, folder):
    return hi.capture_summary(ad.ot_events(spark, folder), ad.alerts(spark, folder))


@query("top_mitre", f"WITH {ad.AL_SQL}, {ad.MITRE_SQL} SELECT technique, count(*) AS n FROM al JOIN mt USING (anomaly_type) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_mitre(spark, folder):
    return hi.top_mitre(ad.alerts(spark, folder))


def _grouped(name, keys, fn):
    query(name, f"WITH {ad.EV_SQL} SELECT {keys}, count(*) AS n FROM ev GROUP BY ALL")(lambda spark, folder: fn(ad.ot_events(spark, folder)))


_grouped("protocol_counts", "protocol", hi.protocol_counts)
_grouped("function_counts", "protocol, function_code", hi.function_counts)
_grouped("risk_counts", "risk_level", hi.risk_counts)
_grouped("conversation_counts", "src_ip, dst_ip, protocol", hi.conversation_counts)


@query("ip_pair_bytes", "SELECT concat('h', CAST(l_suppkey AS VARCHAR)) AS src_ip, concat('p', CAST(l_partkey AS VARCHAR)) AS dst_ip, CAST(sum(l_linenumber) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL")
def ip_pair_bytes(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("src_ip"),
                                                   F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst_ip"), F.col("l_linenumber").alias("ip_len"))
    return hi.ip_pair_bytes(rows)


@query("endpoint_packets", f"WITH {ad.SG_SQL} SELECT ip, count(*) AS packets FROM (SELECT src_ip AS ip FROM sg UNION ALL SELECT dst_ip FROM sg) GROUP BY 1")
def endpoint_packets(spark, folder):
    return hi.endpoint_packets(ad.segments(spark, folder))


@query("port_counts", f"WITH {ad.SG_SQL} SELECT 'TCP' AS transport, dst_port, count(*) AS n FROM sg GROUP BY ALL")
def port_counts(spark, folder):
    return hi.port_counts(ad.segments(spark, folder))


@query("flag_counts", f"WITH {ad.SG_SQL} SELECT count(*) FILTER (WHERE (tcp_flags & 2) <> 0) AS syn, count(*) FILTER (WHERE (tcp_flags & 4) <> 0) AS rst, count(*) FILTER (WHERE (tcp_flags & 18) = 18) AS synack FROM sg")
def flag_counts(spark, folder):
    return hi.flag_counts(ad.segments(spark, folder))


@query("synack_ports", f"WITH {ad.SG_SQL} SELECT src_ip, array_to_string(list_sort(list(DISTINCT src_port)), ',') AS ports FROM sg WHERE (tcp_flags & 18) = 18 GROUP BY 1")
def synack_ports(spark, folder):
    return hi.synack_ports(ad.segments(spark, folder)).withColumn("ports", F.array_join("ports", ","))


@query("alert_overview", f"WITH {ad.AL_SQL} SELECT seq, severity FROM al WHERE severity IN ('CRITICAL', 'HIGH') ORDER BY severity, ts_us, seq LIMIT 50")
def alert_overview(spark, folder):
    return hi.alert_overview(ad.alerts(spark, folder)).select("seq", "severity")


@query("attack_sources", f"""WITH {ad.AL_SQL} SELECT src_ip, count(*) AS count, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(DISTINCT dst_ip) AS targets
FROM al GROUP BY 1 ORDER BY 3 DESC, 4 DESC, 2 DESC, 1 LIMIT 6""")
def attack_sources(spark, folder):
    return hi.attack_sources(ad.alerts(spark, folder))


@query("attack_targets", f"WITH {ad.AL_SQL} SELECT dst_ip, count(*) AS count, count(DISTINCT src_ip) AS sources FROM al GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def attack_targets(spark, folder):
    return hi.attack_targets(ad.alerts(spark, folder))


# --------------------------------------------------------------------------- scalar functions

@query("format_bytes", """SELECT l_orderkey % 50 AS g, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS text
FROM (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) * l_linenumber * l_linenumber * (l_orderkey % 50) * (l_orderkey % 50) * (l_orderkey % 50) * 100 AS b FROM lineitem)""")
def format_bytes(spark, folder):
    m = F.col("l_orderkey") % 50
    n = F.col("l_linenumber").cast("double")
    return table(spark, folder, "lineitem").select(m.alias("g"), scalar.format_bytes(n * n * n * m * m * m * 100).alias("text"))


@query("format_duration", f"""WITH {ad.EV_SQL}, d AS (SELECT seq, (ts_us // 1000000) * (seq % 400) AS s FROM ev)
SELECT seq, CASE WHEN s < 60 THEN concat(s, ' seconds') WHEN s < 3600 THEN concat(s // 60, ' minutes') WHEN s < 86400 THEN concat(s // 3600, 'h ', s % 3600 // 60, 'm') ELSE concat(s // 86400, 'd ', s % 86400 // 3600, 'h') END AS text FROM d""")
def format_duration(spark, folder):
    span = F.floor(F.col("ts_us") / 1_000_000) * (F.col("seq") % 400) * 1_000_000
    return ad.base_events(spark, folder).select("seq", scalar.format_duration(span).alias("text"))


@query("utc_text", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS text FROM events")
def utc_text(spark, folder):
    micros = F.when(F.col("event_id") % 10 == 0, F.lit(0)).otherwise(F.unix_micros(F.col("ts").cast("timestamp")))
    return table(spark, folder, "events").select("event_id", scalar.utc_text(micros).alias("text"))


@query("normalize_ts", """WITH t AS (SELECT event_id, epoch_us(ts) / 1e6 * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE -1 END AS x FROM events)
SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN x WHEN 1 THEN x / 1000 WHEN 2 THEN x / 1000000 END, 3) AS s, CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'milliseconds' WHEN 2 THEN 'microseconds' ELSE 'invalid' END AS kind FROM t""")
def normalize_ts(spark, folder):
    m = F.col("event_id") % 4
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 * F.when(m == 0, 1).when(m == 1, 1000).when(m == 2, 1000000).otherwise(-1)
    return table(spark, folder, "events").select("event_id", F.round(scalar.normalize_ts(x), 3).alias("s"), scalar.ts_correction(x).alias("kind"))


@query("limit_packets", f"WITH {ad.EV_SQL} SELECT seq, ts_us FROM ev ORDER BY seq LIMIT 500")
def limit_packets(spark, folder):
    return ad.base_events(spark, folder).orderBy("seq").limit(500).select("seq", "ts_us")


@query("time_parts", "SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, strftime(ts, '%Y-%m-%d') AS day FROM events")
def time_parts(spark, folder):
    at = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select("event_id", F.hour(at).alias("hour"), F.weekday(at).alias("weekday"), scalar.period(at, "day").alias("day"))


@query("to_timestamp", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000000 END AS micros FROM events""")
def to_timestamp(spark, folder):
    at = F.col("ts").cast("timestamp")
    m = F.col("event_id") % 3
    raw = F.when(m == 0, F.floor(F.unix_micros(at) / 1000000).cast("string")).when(m == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise("n/a")
    return table(spark, folder, "events").select("event_id", F.unix_micros(scalar.to_timestamp(raw)).alias("micros"))


@query("is_private_ip", f"""WITH {ad.EV_SQL}, a AS (SELECT seq, CASE seq % 5 WHEN 0 THEN src_ip WHEN 1 THEN concat('8.8.', k, '.1') WHEN 2 THEN concat('172.', k, '.0.1') WHEN 3 THEN concat('192.168.0.', k) ELSE 'plc' END AS ip FROM ev)
SELECT seq, CASE seq % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31 WHEN 3 THEN TRUE ELSE FALSE END AS private,
 CASE seq % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31 ELSE TRUE END AS internal FROM a""")
def is_private_ip(spark, folder):
    k, m = F.col("k").cast("string"), F.col("seq") % 5
    ip = (F.when(m == 0, F.col("src_ip")).when(m == 1, F.concat(F.lit("8.8."), k, F.lit(".1"))).when(m == 2, F.concat(F.lit("172."), k, F.lit(".0.1")))
          .when(m == 3, F.concat(F.lit("192.168.0."), k)).otherwise("plc"))
    return ad.base_events(spark, folder).select("seq", net.is_private_ip(ip).alias("private"), net.is_internal_ip(ip).alias("internal"))


@query("public_domain_filter", f"WITH {ad.AL_SQL} SELECT host, count(*) AS n FROM (SELECT split_part(host, ':', 1) AS host FROM al) WHERE host NOT LIKE '%.local' GROUP BY 1")
def public_domain_filter(spark, folder):
    rows = ad.alerts(spark, folder).withColumn("host", F.substring_index("host", ":", 1))
    return rows.where(net.is_public_domain(F.col("host"))).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("sanitize_cells", r"""WITH c AS (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-12.5' ELSE '' END, CASE WHEN doc_id % 4 = 1 THEN '' ELSE text END) AS t FROM documents),
d AS (SELECT doc_id, regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS t FROM c), e AS (SELECT doc_id, CASE WHEN length(t) > 2000 THEN concat(substr(t, 1, 2000), '...[truncated]') ELSE t END AS t FROM d)
SELECT doc_id, CASE WHEN length(t) > 1 AND regexp_matches(t, '^[=+\-@\t\r]') AND NOT regexp_full_match(t, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN concat('''', t) ELSE t END AS cell FROM e""")
def sanitize_cells(spark, folder):
    m = F.col("doc_id") % 4
    t = F.concat(F.when(m == 0, "=").when(m == 1, "-12.5").otherwise(""), F.when(m == 1, "").otherwise(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", scalar.safe_cell(t, 2000).alias("cell"))


@query("shannon_entropy", f"""SELECT conv_id, turn, round(coalesce({st.BYTE_ENTROPY.format(x='text')}, 0), 4) AS entropy FROM conversations""")
def shannon_entropy(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.round(text.shannon_entropy(F.encode("text", "UTF-8")), 4).alias("entropy"))


@query("sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.sha256(F.encode("text", "UTF-8")).alias("digest"))


@query("url_decode2", "SELECT doc_id, text FROM documents")
def url_decode2(spark, folder):
    # a quoted space is a plus sign, which one decoding turns back
    quoted = F.url_encode(F.url_encode("text"))
    return table(spark, folder, "documents").select("doc_id", text.url_decode2(quoted).alias("text"))


@query("merge_mitre", f"WITH {ad.EV_SQL} SELECT operation_type, CASE WHEN operation_type = 'READ' THEN 'T0855,T0801,T0802' ELSE 'T0855,T0831,T0836' END AS merged, count(*) AS n FROM ev GROUP BY 1, 2")
def merge_mitre(spark, folder):
    merged = ev.merge_mitre(F.array(F.lit("T0855"), F.lit("T0855")), F.col("mitre"))
    return ad.ot_events(spark, folder).groupBy("operation_type", F.array_join(merged, ",").alias("merged")).agg(F.count(F.lit(1)).alias("n"))


@query("mad", f"""WITH {ad.EV_SQL}, m AS (SELECT protocol, quantile_cont(value, 0.5) AS med FROM ev GROUP BY 1) SELECT protocol, round(med, 6) AS median, round(quantile_cont(abs(value - med), 0.5), 6) AS mad FROM ev JOIN m USING (protocol) GROUP BY 1, 2""")
def mad(spark, folder):
    from fieldtrace.operators.sliced import median_by
    rows = ad.ot_events(spark, folder).select("protocol", "value")
    med = median_by(rows, ["protocol"], "value")
    off = median_by(rows.join(med, "protocol").withColumn("off", F.abs(F.col("value") - F.col("median"))), ["protocol"], "off", "mad")
    return med.join(off, "protocol").select("protocol", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("event_significance", f"""WITH {ad.AL_SQL} SELECT anomaly_type, CASE WHEN contains(anomaly_type, 'WEBSHELL') OR contains(anomaly_type, 'C2') OR contains(anomaly_type, 'PLC') THEN 'CRITICAL - Immediate action required'
 WHEN contains(anomaly_type, 'LATERAL') OR contains(anomaly_type, 'BRUTE') OR contains(anomaly_type, 'EXPLOIT') THEN 'HIGH - Active attack in progress'
 WHEN contains(anomaly_type, 'SCAN') OR contains(anomaly_type, 'PROBE') THEN 'MEDIUM - Reconnaissance activity' ELSE 'NORMAL - Part of attack chain' END AS label, count(*) AS n FROM al GROUP BY 1, 2""")
def event_significance(spark, folder):
    from fieldtrace.operators.chains import event_significance as label
    return ad.alerts(spark, folder).groupBy("anomaly_type", label(F.col("anomaly_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("evidence_json", f"WITH {ad.AL_SQL} SELECT seq, host, k FROM al")
def evidence_json(spark, folder):
    """Evidence written to JSON text and read back with a typed schema."""
    rows = ad.alerts(spark, folder).withColumn("evidence", F.to_json(F.struct("host", "k")))
    return rows.withColumn("e", F.from_json("evidence", "host string, k long")).select(
        "seq", F.get_json_object("evidence", "$.host").alias("host"), F.col("e.k").alias("k"))


@query("export_iocs_csv", f"""WITH {ad.AL_SQL}, d AS (SELECT * EXCLUDE (value), concat('http://', host, uri) AS value FROM al) SELECT 'URL' AS "Type", value AS "Value", CAST(count(*) AS VARCHAR) AS "Occurrences", printf('%.2f', min(ts_us) / 1e6) AS "First_Seen" FROM d GROUP BY value""")
def export_iocs_csv(spark, folder):
    return ioc.csv_rows(ioc.ioc_urls(ad.alerts(spark, folder))).select("Type", "Value", "Occurrences", "First_Seen")
