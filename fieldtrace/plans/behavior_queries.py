"""Behaviour profiling and malware detection over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import behavior as bh
from fieldtrace.operators import malware as mw
from fieldtrace.plans import adapters as ad
from fieldtrace.plans.ot_queries import BASE, fact
from fieldtrace.plans.registry import query


def split_sql(fraction, min_us=10_000_000):
    return f"""{ad.EV_SQL}, sp AS (SELECT min(ts_us) AS t0, max(ts_us) AS t1 FROM ev),
le AS (SELECT t1, greatest(CAST(floor(t0 + CAST({fraction} AS DOUBLE) * (t1 - t0)) AS BIGINT), t0 + {min_us},
 (SELECT max(ts_us) FROM (SELECT ts_us FROM ev ORDER BY ts_us LIMIT 50))) AS learn_end FROM sp),
x AS (SELECT ev.*, le.t1, le.learn_end, ts_us <= learn_end AS learned, src_port > dst_port AND dst_port < 49152 AS req,
 operation_type IN ('WRITE', 'CONTROL') AS dangerous FROM ev, le),
tk AS (SELECT DISTINCT src_ip, dst_ip, protocol FROM x WHERE learned AND req),
ep AS (SELECT src_ip AS ip, protocol FROM x WHERE learned UNION SELECT dst_ip, protocol FROM x WHERE learned),
fk AS (SELECT DISTINCT src_ip, dst_ip, protocol, function_code FROM x WHERE learned AND req),
det AS (SELECT * FROM x WHERE NOT learned AND req)"""


def halves(spark, folder, fraction, min_seconds=10):
    events = ad.ot_events(spark, folder)
    split = bh.learning_split(events, fraction, min_seconds)
    return (*bh.split_events(events, split), split)


@query("learning_split", f"""WITH {split_sql(0.3, 60_000_000)}
SELECT min(ts_us) AS start_us, t1 AS end_us, learn_end AS learn_end_us, count(*) FILTER (WHERE learned) AS learned FROM x GROUP BY ALL""")
def learning_split(spark, folder):
    events = ad.ot_events(spark, folder)
    split = bh.learning_split(events)
    return events.where(F.col("ts_us") <= split.learn_end_us).agg(
        F.lit(split.start_us).alias("start_us"), F.lit(split.end_us).alias("end_us"),
        F.lit(split.learn_end_us).alias("learn_end_us"), F.count(F.lit(1)).alias("learned"))


@query("new_master", f"""WITH {split_sql(0.05)}, h AS (SELECT * FROM det ANTI JOIN tk USING (src_ip, dst_ip, protocol)),
k AS (SELECT dst_ip, protocol, array_to_string(list_sort(list(src_ip))[1:10], ',') AS known_peers FROM tk GROUP BY ALL)
SELECT min(h.ts_us) AS ts_us, h.src_ip, h.dst_ip, h.protocol, CASE WHEN bool_or(dangerous) THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 count(*) AS event_count, any_value(k.known_peers) AS known_peers
FROM h LEFT JOIN k USING (dst_ip, protocol) WHERE (h.dst_ip, h.protocol) IN (SELECT (ip, protocol) FROM ep) GROUP BY ALL""")
def new_master(spark, folder):
    learn, detect, _ = halves(spark, folder, 0.05)
    return bh.new_master(learn, detect).select(
        "ts_us", "src_ip", "dst_ip", "protocol", "severity", fact("event_count"),
        F.when(F.col("evidence")["known_peers"] != "", F.col("evidence")["known_peers"]).alias("known_peers"))


@query("new_device", f"""WITH {split_sql(0.05)}, h AS (SELECT * FROM det ANTI JOIN tk USING (src_ip, dst_ip, protocol))
SELECT min(ts_us) AS ts_us, dst_ip AS device, protocol, count(*) AS event_count,
 (SELECT array_to_string(list_sort(list(s)), ',') FROM (SELECT src_ip AS s, min((ts_us, seq)) AS f FROM h g WHERE g.dst_ip = h.dst_ip AND g.protocol = h.protocol GROUP BY 1 ORDER BY f LIMIT 16)) AS peers
FROM h WHERE (dst_ip, protocol) NOT IN (SELECT (ip, protocol) FROM ep) GROUP BY dst_ip, protocol""")
def new_device(spark, folder):
    learn, detect, _ = halves(spark, folder, 0.05)
    return bh.new_device(learn, detect).select(
        "ts_us", F.col("evidence")["device"].alias("device"), "protocol", fact("event_count"),
        F.col("evidence")["peers"].alias("peers"))


@query("new_function", f"""WITH {split_sql(0.3)}
SELECT min(ts_us) AS ts_us, src_ip, dst_ip, protocol, CAST(function_code AS BIGINT) AS function_code, count(*) AS event_count,
 CASE WHEN bool_or(dangerous OR risk_level IN ('HIGH', 'CRITICAL')) THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM det SEMI JOIN tk USING (src_ip, dst_ip, protocol) ANTI JOIN fk USING (src_ip, dst_ip, protocol, function_code) GROUP BY ALL""")
def new_function(spark, folder):
    learn, detect, _ = halves(spark, folder, 0.3)
    return bh.new_function(learn, detect).select("ts_us", "src_ip", "dst_ip", "protocol", fact("function_code"),
                                                 fact("event_count"), "severity")


def polling_sql(fraction):
    return f"""{split_sql(fraction)}, pg AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, protocol, function_code ORDER BY ts_us, seq) AS gap
 FROM x WHERE learned AND req),
po AS (SELECT src_ip, dst_ip, protocol, function_code, count(*) AS samples, avg(gap) AS mean, stddev_pop(gap) AS std, quantile_cont(gap, 0.5) AS period_us, max(ts_us) AS last_us
 FROM pg GROUP BY ALL HAVING count(*) >= 3 AND avg(gap) > 0 AND stddev_pop(gap) / avg(gap) < 0.7 AND quantile_cont(gap, 0.5) > 0)"""


LEARN = {"min_requests": 3, "max_cv": 0.7}


@query("learn_polling", f"""WITH {polling_sql(0.5)}
SELECT src_ip, dst_ip, protocol, function_code, samples, period_us, last_us, round(std / mean, 4) AS cv FROM po""")
def learn_polling(spark, folder):
    learn, _, _ = halves(spark, folder, 0.5)
    return bh.learn_polling(learn, **LEARN).withColumn("cv", F.round("cv", 4))


@query("polling_gap", f"""WITH {polling_sql(0.5)},
m AS (SELECT src_ip, dst_ip, protocol, function_code, ts_us, seq, FALSE AS is_end FROM det SEMI JOIN po USING (src_ip, dst_ip, protocol, function_code)
 UNION ALL SELECT src_ip, dst_ip, protocol, function_code, last_us, -1, FALSE FROM po
 UNION ALL SELECT src_ip, dst_ip, protocol, function_code, t1, 4611686018427387904, TRUE FROM po, le),
g AS (SELECT *, lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, protocol, function_code ORDER BY ts_us, seq) AS p FROM m),
h AS (SELECT g.*, ts_us - p AS gap, greatest(5 * period_us, period_us + 5000000) AS lim FROM g JOIN po USING (src_ip, dst_ip, protocol, function_code) WHERE p IS NOT NULL)
SELECT src_ip, dst_ip, protocol, CAST(function_code AS BIGINT) AS function_code, min_by(p, (ts_us, seq)) AS gap_start, min_by(gap, (ts_us, seq)) AS gap_us,
 count(*) AS gap_count, max(gap) AS longest_gap, CASE WHEN min_by(is_end, (ts_us, seq)) THEN 'STOPPED' ELSE 'INTERRUPTED' END AS deviation
FROM h WHERE gap > lim GROUP BY ALL""")
def polling_gap(spark, folder):
    learn, detect, split = halves(spark, folder, 0.5)
    return bh.polling_gap(learn, detect, split, **LEARN).select(
        "src_ip", "dst_ip", "protocol", fact("function_code"), fact("gap_start"), fact("gap_us"), fact("gap_count"),
        fact("longest_gap"), F.col("evidence")["deviation"].alias("deviation"))


@query("polling_storm", f"""WITH {polling_sql(0.5)},
d AS (SELECT det.*, CAST(floor(period_us * 3) AS BIGINT) AS w FROM det JOIN po USING (src_ip, dst_ip, protocol, function_code)),
c AS (SELECT *, (SELECT count(*) FROM d a WHERE a.src_ip = b.src_ip AND a.dst_ip = b.dst_ip AND a.protocol = b.protocol AND a.function_code = b.function_code
 AND (a.ts_us, a.seq) <= (b.ts_us, b.seq) AND a.ts_us >= b.ts_us - b.w) AS n FROM d b)
SELECT src_ip, dst_ip, protocol, CAST(function_code AS BIGINT) AS function_code, min(ts_us) AS ts_us, max(n) AS max_in_window FROM c WHERE n > 3 GROUP BY ALL""")
def polling_storm(spark, folder):
    learn, detect, _ = halves(spark, folder, 0.5)
    return bh.polling_storm(learn, detect, periods=3, factor=1.0, **LEARN).select(
        "src_ip", "dst_ip", "protocol", fact("function_code"), "ts_us", fact("max_in_window"))


def range_sql():
    return f"""{split_sql(0.6)}, wr AS (SELECT * FROM x WHERE operation_type = 'WRITE'),
md AS (SELECT dst_ip, protocol, target, count(*) AS samples, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS med
 FROM wr WHERE learned GROUP BY ALL HAVING count(*) >= 2),
rg AS (SELECT md.*, m.mad, greatest(m.mad, 0.01 * abs(med), 1e-9) AS mad_eff FROM md JOIN (
 SELECT dst_ip, protocol, target, quantile_cont(abs(value - med), 0.5) AS mad FROM wr JOIN md USING (dst_ip, protocol, target) WHERE learned GROUP BY ALL) m USING (dst_ip, protocol, target))"""


@query("learn_value_range", f"""WITH {range_sql()}
SELECT dst_ip, protocol, target, samples, lo AS min, hi AS max, round(med, 4) AS median, round(mad, 4) AS mad FROM rg""")
def learn_value_range(spark, folder):
    learn, _, _ = halves(spark, folder, 0.6)
    return bh.learn_value_range(learn, min_samples=2).select(
        "dst_ip", "protocol", "target", "samples", "min", "max", F.round("median", 4).alias("median"),
        F.round("mad", 4).alias("mad"))


@query("value_out_of_range", f"""WITH {range_sql()},
h AS (SELECT w.*, abs(w.value - r.med) AS dev, r.mad_eff FROM wr w JOIN rg r USING (dst_ip, protocol, target)
 WHERE NOT learned AND NOT (w.value BETWEEN r.lo AND r.hi) AND abs(w.value - r.med) > 2 * r.mad_eff)
SELECT dst_ip, protocol, target, min(ts_us) AS ts_us, count(*) AS occurrences, min_by(src_ip, (ts_us, seq)) AS src_ip,
 max_by(value, (dev, -ts_us, -seq)) AS extreme_value, round(max(dev) / any_value(mad_eff), 3) AS deviation_mads FROM h GROUP BY ALL""")
def value_out_of_range(spark, folder):
    learn, detect, _ = halves(spark, folder, 0.6)
    return bh.value_out_of_range(learn, detect, factor=2.0, min_samples=2).select(
        "dst_ip", "protocol", F.col("evidence")["target"].alias("target"), "ts_us", fact("occurrences"), "src_ip",
        fact("extreme_value", "double"), F.round(F.col("evidence")["deviation_mads"].cast("double"), 3).alias("deviation_mads"))


# --------------------------------------------------------------------------- malware

def _wr(a, w):
    return f"""(SELECT {a} FROM ev a WHERE a.src_ip = b.src_ip AND a.operation_type IN ('WRITE', 'CONTROL')
 AND (a.ts_us, a.seq) <= (b.ts_us, b.seq) AND a.ts_us > b.ts_us - {w})"""


@query("malware_signature", f"""WITH {ad.EV_SQL}, c AS (SELECT b.*, {_wr('count(*)', 60_000_000)} AS wm, {_wr('count(DISTINCT a.dst_ip)', 300_000_000)} AS wt FROM ev b),
s AS (SELECT *, CASE WHEN protocol = 'IEC_104' AND function_code IN (45, 46) AND wm >= 20 THEN 'INDUSTROYER_001'
  WHEN protocol = 'MODBUS_TCP' AND function_code IN (6, 16) AND (wm >= 4 OR wt >= 3) THEN 'PIPEDREAM_002' END AS signature_id FROM c)
SELECT ts_us, seq, src_ip, dst_ip, protocol, signature_id, wm AS writes_minute, wt AS write_targets,
 round(least(CAST(0.99 AS DOUBLE), CASE WHEN signature_id LIKE 'IND%' THEN 1.02 ELSE 0.93 + CASE WHEN wm >= 4 THEN 0.05 ELSE 0 END + CASE WHEN wt >= 3 THEN 0.05 ELSE 0 END END), 4) AS confidence
FROM s WHERE signature_id IS NOT NULL""")
def malware_signature(spark, folder):
    return mw.malware_signature(ad.ot_events(spark, folder), min_rate=4).select(
        *BASE, F.col("evidence")["signature_id"].alias("signature_id"), fact("writes_minute"), fact("write_targets"),
        F.round("confidence", 4).cast("double").alias("confidence"))


@query("rapid_ot_writes", f"""WITH {ad.EV_SQL}, r AS (SELECT src_ip, count(*) AS n, min(ts_us) AS lo, max(ts_us) AS hi FROM ev
 WHERE operation_type IN ('WRITE', 'CONTROL') GROUP BY 1)
SELECT src_ip, hi AS ts_us, n AS write_count, round(n / ((hi - lo) / 1e6), 6) AS write_rate FROM r WHERE hi > lo AND n / ((hi - lo) / 1e6) >= 0.06""")
def rapid_ot_writes(spark, folder):
    return mw.rapid_ot_writes(ad.ot_events(spark, folder), per_second=0.06).select(
        "src_ip", "ts_us", fact("write_count"), F.round(F.col("evidence")["write_rate"].cast("double"), 6).alias("write_rate"))


@query("multi_protocol_attack", f"""WITH {ad.EV_SQL}
SELECT src_ip, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols, count(*) FILTER (WHERE operation_type IN ('WRITE', 'CONTROL')) AS attack_events
FROM ev GROUP BY 1 HAVING count(DISTINCT protocol) >= 3 AND count(*) FILTER (WHERE operation_type IN ('WRITE', 'CONTROL')) >= 3""")
def multi_protocol_attack(spark, folder):
    return mw.multi_protocol_attack(ad.ot_events(spark, folder)).select(
        "src_ip", F.col("evidence")["protocols"].alias("protocols"), fact("attack_events"))


def first_code_sql(where):
    return f"""WITH {ad.EV_SQL} SELECT src_ip, min(ts_us) AS ts_us, min_by(dst_ip, (ts_us, seq)) AS dst_ip, min_by(protocol, (ts_us, seq)) AS protocol
FROM ev WHERE {where} GROUP BY src_ip"""


@query("program_modification", first_code_sql(
    "(protocol = 'S7COMM' AND function_code = 26) OR (protocol = 'ENIP' AND notes = 'CIP=0x4D') OR (protocol = 'MODBUS_TCP' AND function_code = 90)"))
def program_modification(spark, folder):
    return mw.program_modification(ad.ot_events(spark, folder)).select("src_ip", "ts_us", "dst_ip", "protocol")


@query("controller_stop", first_code_sql(
    "(protocol = 'S7COMM' AND function_code = 41) OR (protocol = 'DNP3' AND function_code = 18) OR (protocol = 'ENIP' AND notes = 'CIP=0x07')"))
def controller_stop(spark, folder):
    return mw.controller_stop(ad.ot_events(spark, folder)).select("src_ip", "ts_us", "dst_ip", "protocol")


@query("malware_summary", f"""WITH {ad.EV_SQL}, c AS (SELECT b.*, {_wr('count(*)', 60_000_000)} AS wm, {_wr('count(DISTINCT a.dst_ip)', 300_000_000)} AS wt FROM ev b
 WHERE (protocol = 'MODBUS_TCP' AND function_code IN (6, 16)) OR (protocol = 'IEC_104' AND function_code IN (45, 46))),
d AS (SELECT ts_us, seq, 'INDUSTROYER' AS family, 'CRITICAL' AS severity, 'INDUSTROYER - IEC 104 Rapid Commands' AS name, CAST(0.99 AS DOUBLE) AS confidence FROM c WHERE protocol = 'IEC_104' AND wm >= 20
 UNION ALL SELECT ts_us, seq, 'PIPEDREAM', 'CRITICAL', 'PIPEDREAM - Modbus Mass Write',
  round(least(CAST(0.99 AS DOUBLE), 0.93 + CASE WHEN wm >= 4 THEN 0.05 ELSE 0 END + CASE WHEN wt >= 3 THEN 0.05 ELSE 0 END), 4) FROM c WHERE protocol = 'MODBUS_TCP' AND (wm >= 4 OR wt >= 3)),
r AS (SELECT *, row_number() OVER (ORDER BY ts_us DESC NULLS LAST, seq DESC NULLS LAST, family DESC, severity DESC, name DESC, confidence DESC) AS place FROM d)
SELECT 'total' AS part, CAST(NULL AS INT) AS place, count(*) AS detections, CAST(NULL AS BIGINT) AS ts_us, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS family, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS confidence FROM d
UNION ALL SELECT 'severity', NULL, count(d.severity), NULL, NULL, NULL, s.severity, NULL, NULL FROM (VALUES ('CRITICAL'), ('HIGH')) s(severity) LEFT JOIN d ON d.severity = s.severity GROUP BY s.severity
UNION ALL SELECT 'family', NULL, count(*), NULL, NULL, family, severity, NULL, NULL FROM d GROUP BY family, severity
UNION ALL SELECT 'recent', CAST(place AS INT), NULL, ts_us, seq, family, severity, name, confidence FROM r WHERE place <= 10""")
def malware_summary(spark, folder):
    return mw.malware_summary(mw.malware_signature(ad.ot_events(spark, folder), min_rate=4)).withColumn("confidence", F.round("confidence", 4))
