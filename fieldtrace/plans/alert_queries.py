"""Alert shaping, inventory, chains and scores over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import alerts as al
from fieldtrace.operators import assets as st_assets
from fieldtrace.operators import chains as ch
from fieldtrace.operators import scoring as sc
from fieldtrace.plans import adapters as ad
from fieldtrace.plans import sqltext as st
from fieldtrace.plans.registry import query, table

KEY = "anomaly_type, src_ip, dst_ip"


@query("dedup_alerts", f"""WITH {ad.AL_SQL}, {st.anchors('al', KEY, 100_000_000, strict=False)}, {st.windows('al', KEY)}
SELECT anomaly_type, src_ip, dst_ip, min_by(ts_us, (ts_us, seq)) AS ts_us, min_by(seq, (ts_us, seq)) AS seq, count(*) AS occurrences, max(ts_us) AS last_us,
 round(least(1.0, min_by(confidence, (ts_us, seq)) + 0.02 * (count(*) - 1)), 4) AS confidence,
 CASE WHEN count(*) > 10 AND min_by(severity, (ts_us, seq)) = 'MEDIUM' THEN 'HIGH' ELSE min_by(severity, (ts_us, seq)) END AS severity
FROM win GROUP BY anomaly_type, src_ip, dst_ip, mark_us""")
def dedup_alerts(spark, folder):
    rows = ad.alerts(spark, folder).select("ts_us", "seq", "anomaly_type", "src_ip", "dst_ip", "confidence", "severity")
    return al.dedup_alerts(rows, window_s=100).withColumn("confidence", F.round("confidence", 4))


@query("suppress_repeats", f"WITH {ad.AL_SQL}, {st.kept('al', KEY, 100_000_000)} SELECT ts_us, seq, anomaly_type, src_ip, dst_ip FROM kept")
def suppress_repeats(spark, folder):
    rows = ad.alerts(spark, folder).select("ts_us", "seq", "anomaly_type", "src_ip", "dst_ip")
    return al.suppress_repeats(rows, window_s=100)


BASE_SQL = f"""{ad.EV_SQL}, g AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us, seq)) / 1e6 AS gap FROM ev),
bl AS (SELECT src_ip, dst_ip, protocol, count(*) AS samples, avg(gap) AS ai, stddev_pop(gap) AS si, min(gap) AS mi, max(gap) AS xi,
 array_to_string(list_sort(list(DISTINCT function_code)), ',') AS function_codes, min(ts_us) AS first_us, max(ts_us) AS last_us,
 max(ts_us) - min(ts_us) >= 650000000 AS is_stable FROM g GROUP BY ALL)"""


@query("learn_baseline", f"""WITH {BASE_SQL} SELECT src_ip, dst_ip, protocol, samples, round(ai, 4) AS avg_interval, round(si, 4) AS std_interval,
 CAST(round(mi * 1e6) AS BIGINT) AS min_interval, CAST(round(xi * 1e6) AS BIGINT) AS max_interval, function_codes, first_us, last_us, is_stable, '0' AS hours FROM bl""")
def learn_baseline(spark, folder):
    rows = al.learn_baseline(ad.ot_events(spark, folder), period_s=650)
    return rows.select("src_ip", "dst_ip", "protocol", "samples",
                       *[F.round(c, 4).alias(c) for c in ("avg_interval", "std_interval")],
                       *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("min_interval", "max_interval")],
                       F.array_join("function_codes", ",").alias("function_codes"), "first_us", "last_us", "is_stable",
                       F.array_join("active_hours", ",").alias("hours"))


@query("baseline_stats", f"""WITH {BASE_SQL} SELECT count(*) AS total_baselines, count(*) FILTER (WHERE is_stable) AS stable_baselines,
 count(*) FILTER (WHERE NOT is_stable) AS learning_baselines, CAST(sum(samples) AS BIGINT) AS events_learned, CAST(2 AS BIGINT) AS whitelist_rules, CAST(1 AS BIGINT) AS active_rules FROM bl""")
def baseline_stats(spark, folder):
    return al.baseline_stats(al.learn_baseline(ad.ot_events(spark, folder), period_s=650), 2, 1)


RULES = [al.WhitelistRule(src_ip="10.1.0.1*", protocol="MODBUS_TCP", dst_port="500-600", reduction=0.3),
         al.WhitelistRule(dst_ip="10.2.3.*", function_codes=(3, 4), reduction=0.25),
         al.WhitelistRule(src_ip="10.1.0.5", reduction=0.9, enabled=False)]


@query("adjust_confidence", f"""WITH {ad.AL_SQL}, f AS (SELECT src_ip, dst_ip, protocol, min(ts_us) AS first_us FROM ev GROUP BY ALL),
r AS (SELECT al.*, first_us, al.src_ip LIKE '10.1.0.1%' AND al.protocol = 'MODBUS_TCP' AND dst_port BETWEEN 500 AND 600 AS r1,
 al.dst_ip LIKE '10.2.3.%' AND function_code IN (3, 4) AS r2 FROM al JOIN f USING (src_ip, dst_ip, protocol)),
c AS (SELECT *, greatest(0, confidence - CASE WHEN r1 THEN 0.3 ELSE 0 END - CASE WHEN r2 THEN 0.25 ELSE 0 END) AS c FROM r),
d AS (SELECT *, c * CASE WHEN ts_us - first_us >= 300000000 THEN 0.8 * 0.8 * 0.9 ELSE 1 END AS adj FROM c WHERE NOT ((r1 OR r2) AND round(c, 9) < 0.2))
SELECT seq, src_ip, anomaly_type, CAST(round(adj, 4) AS DOUBLE) AS confidence FROM d WHERE NOT (ts_us - first_us >= 300000000 AND adj < 0.15)""")
def adjust_confidence(spark, folder):
    return al.adjust_confidence(ad.alerts(spark, folder), ad.ot_events(spark, folder), RULES, period_s=300).select(
        "seq", "src_ip", "anomaly_type", F.round("confidence", 4).alias("confidence"))


VIOLATION = "CASE severity WHEN 'CRITICAL' THEN 0.12 WHEN 'HIGH' THEN 0.08 ELSE 0.02 END"


def violations(spark, folder):
    return ad.alerts(spark, folder).select(
        F.col("src_ip").alias("ip"), "ts_us", "seq", F.col("anomaly_type").alias("reason"),
        F.when(F.col("severity") == "CRITICAL", 0.12).when(F.col("severity") == "HIGH", 0.08).otherwise(0.02).alias("delta"))


RISK_SQL = f"""{ad.AL_SQL}, v AS (SELECT src_ip AS ip, ts_us, seq, anomaly_type AS reason, CAST({VIOLATION} AS DOUBLE) AS delta FROM al),
o AS (SELECT b.*, (SELECT count(*) FROM v a WHERE a.ip = b.ip AND a.ts_us < b.ts_us - 60000000) AS old FROM v b),
rs AS (SELECT ip, list_reduce(list_transform(list({{'d': delta, 'c': least(old * 0.01, 0.1)}} ORDER BY ts_us, seq), lambda s: [s.d, s.c]),
 lambda a, s: [least(1.0, greatest(0.0, a[1] - s[2]) + s[1]), 0.0])[1] AS risk_score FROM o GROUP BY ip)"""


@query("ip_risk_score", f"WITH {RISK_SQL} SELECT ip, round(risk_score, 6) AS risk_score FROM rs")
def ip_risk_score(spark, folder):
    return al.ip_risk_score(violations(spark, folder), decay_s=60).withColumn("risk_score", F.round("risk_score", 6))


@query("ip_risk_profile", f"""WITH {RISK_SQL}, t AS (SELECT DISTINCT src_ip AS ip FROM ev WHERE protocol = 'MODBUS_TCP' AND function_code = 90),
l AS (SELECT ip, array_to_string(list(reason ORDER BY ts_us, seq), ',') AS violations FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us DESC, seq DESC) AS n FROM v) WHERE n <= 10 GROUP BY ip)
SELECT rs.ip, round(risk_score, 6) AS risk_score, t.ip IS NOT NULL AS touched_ot, l.violations, (SELECT count(*) FROM v WHERE v.ip = rs.ip) AS violation_count,
 CASE WHEN risk_score >= 0.7 AND t.ip IS NOT NULL THEN 'CRITICAL' WHEN risk_score >= 0.5 OR (risk_score >= 0.3 AND t.ip IS NOT NULL) THEN 'HIGH'
 WHEN risk_score >= 0.2 THEN 'MEDIUM' WHEN risk_score > 0 THEN 'LOW' ELSE 'NONE' END AS threat_level FROM rs LEFT JOIN t USING (ip) LEFT JOIN l USING (ip)""")
def ip_risk_profile(spark, folder):
    v = violations(spark, folder)
    touched = ad.ot_events(spark, folder).where("protocol = 'MODBUS_TCP' AND function_code = 90").select(F.col("src_ip").alias("ip"))
    return al.ip_risk_profile(al.ip_risk_score(v, decay_s=60), v, touched).select(
        "ip", F.round("risk_score", 6).alias("risk_score"), "touched_ot", "violation_count",
        F.array_join("violations", ",").alias("violations"), "threat_level")


# --------------------------------------------------------------------------- inventory

ASSET_SQL = f"""{ad.SG_SQL}, s AS (SELECT src_ip AS ip, src_mac AS mac, ts_us, seq, CAST(ip_len AS BIGINT) AS sent, src_port AS port FROM sg
 UNION ALL SELECT dst_ip, '', ts_us, seq, 0, dst_port FROM sg),
h AS (SELECT ip, min_by(mac, (ts_us, seq)) FILTER (WHERE mac <> '') AS mac, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, CAST(sum(sent) AS BIGINT) AS bytes,
 array_to_string(list_sort(list(DISTINCT port)), ',') AS ports FROM s GROUP BY ip),
pr AS (SELECT ip, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols FROM (SELECT src_ip AS ip, protocol FROM ev UNION SELECT dst_ip, protocol FROM ev) GROUP BY ip)"""


def inventory(spark, folder):
    return st_assets.track_assets(ad.segments(spark, folder), ad.ot_events(spark, folder))


@query("track_assets", f"""WITH {ASSET_SQL} SELECT h.*, coalesce(protocols, '') AS protocols, protocols IS NOT NULL AS is_ot FROM h LEFT JOIN pr USING (ip)""")
def track_assets(spark, folder):
    return inventory(spark, folder).withColumn("ports", F.array_join("ports", ",")).withColumn(
        "protocols", F.array_join("protocols", ","))


@query("classify_asset", f"""WITH {ASSET_SQL} SELECT ip, CASE WHEN protocols IS NULL THEN 'Unknown' ELSE 'OT' END AS classification FROM h LEFT JOIN pr USING (ip)""")
def classify_asset(spark, folder):
    return st_assets.classify_asset(inventory(spark, folder)).select("ip", "classification")


RISKY_SQL = f"""{ASSET_SQL}, al AS ({ad._ALERT.format(source='ev', text='VARCHAR', sess='(user_id // 5)')}),
inv AS (SELECT ip, count(*) AS alerts, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high
 FROM (SELECT src_ip AS ip, severity FROM al UNION ALL SELECT dst_ip, severity FROM al WHERE dst_ip <> src_ip) GROUP BY ip),
pt AS (SELECT h.ip, h.mac, CAST(CASE WHEN critical > 0 THEN 40 ELSE 0 END + CASE WHEN high > 0 THEN 20 ELSE 0 END + CASE WHEN alerts > 10 THEN 10 ELSE 0 END AS BIGINT) AS points FROM h LEFT JOIN inv USING (ip)),
rk AS (SELECT *, CASE WHEN points >= 50 THEN 'CRITICAL' WHEN points >= 30 THEN 'HIGH' WHEN points >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM pt)"""


@query("asset_risk", f"WITH {RISKY_SQL} SELECT ip, points, risk_level FROM rk")
def asset_risk(spark, folder):
    return st_assets.asset_risk(inventory(spark, folder), ad.alerts(spark, folder)).select("ip", "points", "risk_level")


@query("filter_assets", f"WITH {RISKY_SQL} SELECT ip, risk_level FROM rk JOIN pr USING (ip) WHERE risk_level = 'CRITICAL' AND (ip LIKE '%.2.1%' OR mac LIKE '%.2.1%')")
def filter_assets(spark, folder):
    rows = st_assets.classify_asset(st_assets.asset_risk(inventory(spark, folder), ad.alerts(spark, folder)))
    return st_assets.filter_assets(rows, "OT", "CRITICAL", ".2.1").select("ip", "risk_level")


@query("vendor_lookup", """WITH v AS (SELECT DISTINCT substr(p_name, 1, 8) AS prefix, concat('V', substr(p_name, 1, 3)) AS vendor FROM part WHERE length(p_name) > 8
 UNION SELECT DISTINCT substr(p_name, 1, 11), concat('W', substr(p_name, 1, 5)) FROM part WHERE length(p_name) > 11 AND p_partkey % 3 = 0)
SELECT p_partkey, coalesce(b.vendor, c.vendor, 'Unknown') AS vendor FROM part
LEFT JOIN v b ON length(b.prefix) = 11 AND substr(p_name, 1, 11) = b.prefix LEFT JOIN v c ON length(c.prefix) = 8 AND substr(p_name, 1, 8) = c.prefix""")
def vendor_lookup(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("mac"))
    short = part.where(F.length("mac") > 8).select(F.substring("mac", 1, 8).alias("prefix"), F.concat(F.lit("V"), F.substring("mac", 1, 3)).alias("vendor"))
    long = part.where((F.length("mac") > 11) & (F.col("p_partkey") % 3 == 0)).select(
        F.substring("mac", 1, 11).alias("prefix"), F.concat(F.lit("W"), F.substring("mac", 1, 5)).alias("vendor"))
    return st_assets.vendor_lookup(part, short.union(long).distinct()).select("p_partkey", "vendor")


# --------------------------------------------------------------------------- chains

def _case(rows, column, upper=True):
    return "CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in rows) + " END"


PHASE_SQL = _case(ch.PHASES, "anomaly_type")
INDEX_SQL = "list_position([" + ", ".join(f"'{p}'" for p in ch.PHASE_NAMES) + "], phase) - 1"
CHAIN_SQL = f"""{ad.AL_SQL}, {ad.MITRE_SQL}, ph AS (SELECT * FROM (SELECT *, {PHASE_SQL} AS phase, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) AS sr FROM al) WHERE phase IS NOT NULL),
lg AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, seq) > 25000000 THEN 1 ELSE 0 END AS brk FROM ph),
rn AS (SELECT *, sum(brk) OVER (PARTITION BY src_ip ORDER BY ts_us, seq) AS run FROM lg),
cf AS (SELECT src_ip, run, phase, {INDEX_SQL} AS idx, count(*) AS n, min(ts_us) AS lo, max(ts_us) AS hi, max(sr) AS sr FROM rn GROUP BY ALL),
cn AS (SELECT src_ip, run, list(phase ORDER BY idx) AS phases, CAST(sum(n) AS BIGINT) AS total_events, min(lo) AS start_us, max(hi) AS end_us, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(sr)] AS severity
 FROM cf GROUP BY ALL HAVING sum(n) >= 2 AND count(*) >= 2),
tg AS (SELECT DISTINCT src_ip, run, dst_ip FROM rn),
oa AS (SELECT DISTINCT dst_ip FROM ev WHERE protocol = 'MODBUS_TCP' AND event_type = 'error'),
ts AS (SELECT src_ip, run, array_to_string(list_sort(list(dst_ip)), ',') AS target_ips, count(oa.dst_ip) > 0 AS ot FROM tg LEFT JOIN oa USING (dst_ip) GROUP BY ALL),
esc AS (SELECT cn.*, ts.target_ips, ts.ot AS has_ot_impact, least(CAST(1 AS DOUBLE), CAST(CASE WHEN ot THEN 0.3 WHEN list_contains(phases, 'LATERAL_MOVEMENT') THEN 0.2 ELSE 0.1 END AS DOUBLE)
 + CASE severity WHEN 'CRITICAL' THEN 0.3 WHEN 'HIGH' THEN 0.2 WHEN 'MEDIUM' THEN 0.1 ELSE 0.05 END
 + CASE WHEN list_contains(phases, 'IMPACT') THEN 0.2 WHEN list_contains(phases, 'LATERAL_MOVEMENT') OR list_contains(phases, 'EXFILTRATION') THEN 0.15
   WHEN list_contains(phases, 'EXECUTION') THEN 0.1 WHEN list_contains(phases, 'INITIAL_ACCESS') THEN 0.05 ELSE 0 END) AS escalation FROM cn JOIN ts USING (src_ip, run)),
ci AS (SELECT *, concat('CHAIN-', strftime(make_timestamp(start_us), '%Y%m%d%H%M%S'), '-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS chain_id
 FROM (SELECT *, row_number() OVER (ORDER BY start_us) - 1 AS n FROM esc))"""


def ot_hosts(spark, folder):
    return ad.ot_events(spark, folder).where("protocol = 'MODBUS_TCP' AND event_type = 'error'").select(F.col("dst_ip").alias("ip"))


def chains(spark, folder):
    return ch.attack_chains(ad.alerts(spark, folder), gap_s=25, ot_assets=ot_hosts(spark, folder))


@query("detect_phase", f"WITH {ad.AL_SQL}, p AS (SELECT anomaly_type, {PHASE_SQL} AS phase FROM al) SELECT anomaly_type, phase, {INDEX_SQL} AS idx, count(*) AS n FROM p GROUP BY ALL")
def detect_phase(spark, folder):
    phase = ch.detect_phase(F.col("anomaly_type"))
    return ad.alerts(spark, folder).groupBy("anomaly_type", phase.alias("phase")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "idx", ch.phase_index(F.col("phase")))


@query("attack_chains", f"""WITH {CHAIN_SQL} SELECT chain_id, src_ip AS source_ip, array_to_string(phases, ',') AS phases, total_events, start_us, end_us, severity, target_ips,
 round(CAST(least(1.0, 0.3 + 0.15 * len(phases)) AS DOUBLE), 4) AS confidence FROM ci""")
def attack_chains(spark, folder):
    return chains(spark, folder).select(
        "chain_id", "source_ip", F.array_join(F.transform("phases", lambda p: p["phase"]), ",").alias("phases"), "total_events",
        "start_us", "end_us", "severity", F.array_join("target_ips", ",").alias("target_ips"), F.round("confidence", 4).alias("confidence"))


@query("ot_escalation", f"WITH {CHAIN_SQL} SELECT chain_id, has_ot_impact, round(CAST(escalation AS DOUBLE), 4) AS escalation FROM ci")
def ot_escalation(spark, folder):
    return chains(spark, folder).select("chain_id", "has_ot_impact", F.round("escalation", 4).alias("escalation"))


PAIRS_SQL = f"""{CHAIN_SQL}, pa AS (SELECT DISTINCT c.chain_id, a.ts_us, a.seq, a.anomaly_type, a.src_ip, a.dst_ip FROM ci c JOIN al a ON a.ts_us BETWEEN c.start_us AND c.end_us + 60000000
 AND (a.src_ip = c.src_ip OR (c.src_ip, c.run, a.dst_ip) IN (SELECT (src_ip, run, dst_ip) FROM tg)))"""


@query("chain_alerts", f"WITH {PAIRS_SQL} SELECT chain_id, seq, anomaly_type FROM pa")
def chain_alerts(spark, folder):
    return ch.chain_alerts(chains(spark, folder), ad.alerts(spark, folder)).select("chain_id", "seq", "anomaly_type")


def _words(words, column="types"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


STORY_SQL = f"""{PAIRS_SQL}, fi AS (SELECT chain_id, string_agg(anomaly_type, ' ') AS types, count(*) AS alerts FROM pa GROUP BY chain_id),
sy AS (SELECT ci.*, fi.alerts, CASE WHEN {_words(ch.STORY_WORDS[0][1])} THEN 'PLC_MANIPULATION' WHEN {_words(ch.STORY_WORDS[1][1])} AND (has_ot_impact OR escalation > 0.5) THEN 'WEBSHELL_TO_OT'
 WHEN {_words(ch.STORY_WORDS[2][1])} THEN 'DATA_EXFIL_DETECTED' WHEN {_words(ch.STORY_WORDS[3][1])} THEN 'C2_BEACON_DETECTED'
 WHEN {_words(ch.KNOWN_WORDS)} THEN 'GENERIC_ATTACK_CHAIN' ELSE 'UNKNOWN_PATTERN' END AS attack_type FROM ci JOIN fi USING (chain_id))"""


def stories(spark, folder):
    found = chains(spark, folder)
    return found, ch.storyline_table(found, ad.alerts(spark, folder))


@query("classify_storyline", f"WITH {STORY_SQL} SELECT attack_type, count(*) AS chains FROM sy GROUP BY 1")
def classify_storyline(spark, folder):
    return stories(spark, folder)[1].groupBy("attack_type").agg(F.count(F.lit(1)).alias("chains"))


@query("storyline_table", f"""WITH {STORY_SQL} SELECT chain_id, attack_type, alerts, least(alerts, 20) AS key_events,
 CASE WHEN escalation >= 0.8 THEN 'CRITICAL' WHEN escalation >= 0.6 THEN 'HIGH' WHEN escalation >= 0.4 THEN 'MEDIUM' WHEN escalation >= 0.2 THEN 'LOW' ELSE 'NONE' END AS production_risk,
 CASE WHEN end_us = start_us THEN '' WHEN len(phases) / ((end_us - start_us) / 3.6e9) > 2 THEN 'RAPID PROGRESSION (high threat urgency)' ELSE 'other' END AS velocity, array_to_string(phases, ' -> ') AS timeline FROM sy""")
def storyline_table(spark, folder):
    return stories(spark, folder)[1].select("chain_id", "attack_type", F.col("alerts").cast("long").alias("alerts"),
                                            F.size("key_events").cast("long").alias("key_events"), "production_risk", "velocity", "timeline")


@query("chain_list", f"""WITH {STORY_SQL} SELECT chain_id, severity, attack_type FROM sy ORDER BY list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) DESC, start_us DESC, chain_id LIMIT 50""")
def chain_list(spark, folder):
    return ch.chain_list(*stories(spark, folder)).select("chain_id", "severity", "attack_type")


# --------------------------------------------------------------------------- scores

KILL = [(p, t) for p, types in sc.PHASE_TYPES for t in types]
KILL_SQL = ("coalesce(CASE anomaly_type " + " ".join(f"WHEN '{t}' THEN '{p}'" for p, t in KILL) + " END, CASE "
            + " ".join(f"WHEN contains(anomaly_type, '{t}') THEN '{p}'" for p, t in KILL) + " END, "
            + _case(sc.PHASE_WORDS, "lower(anomaly_type)") + ")")


def _map(values, key, default):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


W = sc.Weights()
SCORE_SQL = f"""{ad.AL_SQL}, kp AS (SELECT *, {KILL_SQL} AS phase, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) AS sr,
 starts_with(anomaly_type, 'OT_') OR contains(protocol, 'MODBUS') OR contains(protocol, 'S7') AS ot FROM al),
pp AS (SELECT src_ip, phase, count(*) AS n, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(sr)] AS sev, max(confidence) AS conf, bool_or(ot) AS ot, max(ts_us) AS hi, max((ts_us, seq)) AS last FROM kp GROUP BY ALL),
ss AS (SELECT src_ip, sum(CASE WHEN phase IS NOT NULL THEN CAST({_map(W.severity, 'sev', 0.2)} AS DOUBLE) * n * {_map(W.phase, 'phase', 0.5)} * conf END) AS base, count(phase) AS phase_count,
 CAST(sum(n) AS BIGINT) AS alerts, bool_or(ot) AS has_ot_impact, max(hi) AS last_us, arg_max(phase, CASE WHEN phase IS NOT NULL THEN last END) AS current_phase FROM pp GROUP BY src_ip),
st AS (SELECT *, base * CASE WHEN phase_count >= 3 THEN 1.2 ELSE 1 END * CASE WHEN phase_count >= 5 THEN 1.3 ELSE 1 END * CASE WHEN has_ot_impact THEN 1.3 ELSE 1 END
 * exp(-(720000000 - last_us) / CAST(3.6e9 * 24 AS DOUBLE)) AS total FROM ss),
sl AS (SELECT *, CASE WHEN total / (total + 5) >= 0.8 THEN 'CRITICAL' WHEN total / (total + 5) >= 0.6 THEN 'HIGH' WHEN total / (total + 5) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM st)"""


def scores(spark, folder):
    return sc.threat_score(ad.alerts(spark, folder), as_of_us=720_000_000)


@query("kill_chain_phase", f"WITH {ad.AL_SQL} SELECT anomaly_type, {KILL_SQL} AS phase, count(*) AS n FROM al GROUP BY ALL")
def kill_chain_phase(spark, folder):
    return ad.alerts(spark, folder).groupBy("anomaly_type", sc.kill_chain_phase(F.col("anomaly_type")).alias("phase")).agg(
        F.count(F.lit(1)).alias("n"))


@query("threat_score", f"""WITH {SCORE_SQL} SELECT src_ip, phase_count, alerts, has_ot_impact, current_phase, round(total, 4) AS total_score, round(total / (total + 5), 4) AS normalized_score, threat_level FROM sl""")
def threat_score(spark, folder):
    return scores(spark, folder).select("src_ip", "phase_count", "alerts", "has_ot_impact", "current_phase",
                                        F.round("total_score", 4).alias("total_score"),
                                        F.round("normalized_score", 4).alias("normalized_score"), "threat_level")


NEXT_SQL = "CASE WHEN current_phase IS NULL THEN 'RECONNAISSANCE' WHEN has_ot_impact AND current_phase <> 'IMPACT' THEN 'IMPACT' ELSE " + _map(
    {k: f"'{n}'" for k, (n, _) in sc.NEXT_PHASE.items()}, "current_phase", "'IMPACT'") + " END"


@query("predict_next_phase", f"WITH {SCORE_SQL} SELECT src_ip, current_phase, {NEXT_SQL} AS next_phase FROM sl")
def predict_next_phase(spark, folder):
    return sc.predict_next_phase(scores(spark, folder)).select("src_ip", "current_phase", "next_phase")


@query("threat_summary", f"WITH {SCORE_SQL} SELECT threat_level, count(*) AS ips, count(*) FILTER (WHERE has_ot_impact) AS ot_targeting, CAST(sum(alerts) AS BIGINT) AS alerts FROM sl GROUP BY 1")
def threat_summary(spark, folder):
    return sc.threat_summary(scores(spark, folder)).drop("malware")


@query("critical_ips", f"WITH {SCORE_SQL} SELECT src_ip FROM sl WHERE threat_level = 'CRITICAL'")
def critical_ips(spark, folder):
    return sc.critical_ips(scores(spark, folder))


@query("ot_targeting_ips", f"WITH {SCORE_SQL} SELECT src_ip FROM sl WHERE has_ot_impact")
def ot_targeting_ips(spark, folder):
    return sc.ot_targeting_ips(scores(spark, folder))


@query("threat_report", f"""WITH {SCORE_SQL} SELECT src_ip AS ip, threat_level, round(total, 2) AS total_score, {NEXT_SQL} AS next_phase,
 CASE threat_level WHEN 'CRITICAL' THEN 2 + CASE WHEN has_ot_impact THEN 2 ELSE 0 END WHEN 'HIGH' THEN 2 + CASE WHEN has_ot_impact THEN 2 ELSE 0 END WHEN 'MEDIUM' THEN 3 ELSE 1 END AS advice FROM sl""")
def threat_report(spark, folder):
    return sc.threat_report(scores(spark, folder)).select("ip", "threat_level", "total_score", F.col("kill_chain.next_phase").alias("next_phase"),
                                                          F.size("recommendations").alias("advice"))


@query("top_threats", f"WITH {SCORE_SQL} SELECT src_ip, threat_level FROM sl ORDER BY round(total, 9) DESC, src_ip LIMIT 10")
def top_threats(spark, folder):
    return sc.top_threats(scores(spark, folder)).select("src_ip", "threat_level")
