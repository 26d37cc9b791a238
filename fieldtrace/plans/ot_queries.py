"""Protocol-event detectors over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import ot
from fieldtrace.plans import adapters as ad
from fieldtrace.plans.registry import query

BASE = ["ts_us", "seq", "src_ip", "dst_ip", "protocol"]


def fact(name: str, kind: str = "long"):
    return F.col("evidence")[name].cast(kind).alias(name)


@query("rapid_write_sequence", f"""
WITH {ad.EV_SQL}, w AS (SELECT *, operation_type IN ('WRITE', 'CONTROL') AS wr FROM ev)
SELECT ts_us, seq, src_ip, dst_ip, protocol, write_count, span_us FROM (
 SELECT *, CAST(sum(CASE WHEN wr THEN 1 ELSE 0 END) OVER f AS BIGINT) AS write_count, ts_us - min(ts_us) OVER f AS span_us FROM w
 WINDOW f AS (PARTITION BY src_ip, dst_ip ORDER BY ts_us, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
WHERE write_count >= 7 AND span_us < 400000000""")
def rapid_write_sequence(spark, folder):
    return ot.rapid_write_sequence(ad.ot_events(spark, folder), span_s=400).select(
        *BASE, fact("write_count"), fact("span_us"))


@query("abnormal_write_rate", f"""
WITH {ad.EV_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us, seq) AS rn,
  count(*) OVER (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent
 FROM ev WHERE operation_type IN ('WRITE', 'CONTROL')),
e AS (SELECT *, count(*) OVER (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 60000000 FOLLOWING) AS ahead
 FROM w WHERE rn <= 8),
b AS (SELECT src_ip, dst_ip, protocol, avg(CASE WHEN rn <= 4 THEN ahead END) AS mean, stddev_pop(CASE WHEN rn <= 4 THEN ahead END) AS std
 FROM e GROUP BY ALL HAVING max(rn) >= 8)
SELECT w.ts_us, w.seq, w.src_ip, w.dst_ip, w.protocol, recent AS current_rate, round(mean, 4) AS baseline_mean
FROM w JOIN b USING (src_ip, dst_ip, protocol) WHERE rn >= 8 AND recent > mean + 1.0 * std AND recent > 1""")
def abnormal_write_rate(spark, folder):
    return ot.abnormal_write_rate(ad.ot_events(spark, folder), warmup=8, windows=4, sigmas=1.0, min_recent=1).select(
        *BASE, fact("current_rate"), F.round(F.col("evidence")["baseline_mean"].cast("double"), 4).alias("baseline_mean"))


@query("ot_replay", f"""
WITH {ad.EV_SQL}, w AS (SELECT *, concat(src_ip, ':', CAST(src_port AS VARCHAR)) AS flow FROM ev
 WHERE operation_type IN ('WRITE', 'CONTROL', 'CONFIG') AND length(raw) > 10)
SELECT b.ts_us, b.seq, b.src_ip, b.dst_ip, b.protocol, min(a.ts_us) AS original_us, min_by(a.flow, (a.ts_us, a.seq)) AS original_source
FROM w a JOIN w b ON a.protocol = b.protocol AND a.dst_ip = b.dst_ip AND a.raw = b.raw AND a.flow <> b.flow
 AND (a.ts_us, a.seq) < (b.ts_us, b.seq) AND b.ts_us - a.ts_us < 300000000
GROUP BY ALL""")
def ot_replay(spark, folder):
    return ot.ot_replay(ad.ot_events(spark, folder)).select(
        *BASE, fact("original_us"), F.col("evidence")["original_source"].alias("original_source"))


@query("firmware_manipulation", f"""
WITH {ad.EV_SQL} SELECT ts_us, seq, src_ip, dst_ip, protocol,
 CASE WHEN protocol = 'S7COMM' THEN 'S7_DOWNLOAD_SEQUENCE,S7_FIRMWARE_DOWNLOAD' ELSE 'MODBUS_FIRMWARE_UPDATE' END AS indicators
FROM ev WHERE (protocol = 'S7COMM' AND function_code = 26) OR (protocol = 'MODBUS_TCP' AND function_code = 90)""")
def firmware_manipulation(spark, folder):
    return ot.firmware_manipulation(ad.ot_events(spark, folder)).select(*BASE, F.col("evidence")["indicators"].alias("indicators"))


@query("setpoint_manipulation", f"""
WITH {ad.EV_SQL}, w AS (SELECT * FROM ev WHERE operation_type IN ('WRITE', 'CONTROL')),
c AS (SELECT b.ts_us, b.seq, b.src_ip, b.dst_ip, b.protocol, count(*) AS write_count, count(DISTINCT a.data_address) AS unique_addresses
 FROM w b JOIN w a ON a.dst_ip = b.dst_ip AND a.protocol = b.protocol AND (a.ts_us, a.seq) <= (b.ts_us, b.seq) AND a.ts_us > b.ts_us - 300000000
 GROUP BY ALL)
SELECT * FROM c WHERE write_count > 4 AND unique_addresses < write_count * 0.95""")
def setpoint_manipulation(spark, folder):
    return ot.setpoint_manipulation(ad.ot_events(spark, folder), window_s=300, min_writes=4, address_ratio=0.95).select(
        *BASE, fact("write_count"), fact("unique_addresses"))


@query("protocol_state_violation", f"""
WITH {ad.EV_SQL}, w AS (SELECT *, notes LIKE '%U-Frame%' AS uf, operation_type IN ('WRITE', 'CONTROL') AS wr,
  lag(function_code) OVER k AS last_fc,
  max(CASE WHEN (protocol = 'S7COMM' AND (function_code = 240 OR operation_type NOT IN ('WRITE', 'CONTROL')))
   OR (protocol = 'IEC_104' AND notes LIKE '%U-Frame%' AND function_name LIKE '%STARTDT%') THEN 1 ELSE 0 END)
   OVER (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened
 FROM ev WINDOW k AS (PARTITION BY src_ip, dst_ip, protocol ORDER BY ts_us, seq)),
v AS (SELECT *, CASE
  WHEN protocol = 'S7COMM' AND coalesce(opened, 0) = 0 AND function_code NOT IN (240, 0) AND wr THEN 'S7_WRITE_WITHOUT_SETUP'
  WHEN protocol = 'IEC_104' AND coalesce(opened, 0) = 0 AND uf AND function_name LIKE '%STOPDT%' THEN 'IEC104_STOP_WITHOUT_START'
  WHEN protocol = 'IEC_104' AND coalesce(opened, 0) = 0 AND NOT uf AND operation_type = 'CONTROL' THEN 'IEC104_CONTROL_WITHOUT_STARTDT'
  WHEN protocol = 'DNP3' AND function_code = 4 AND coalesce(last_fc, -1) NOT IN (3, 4) THEN 'DNP3_OPERATE_WITHOUT_SELECT' END AS violation_type FROM w)
SELECT ts_us, seq, src_ip, dst_ip, protocol, violation_type FROM v WHERE violation_type IS NOT NULL""")
def protocol_state_violation(spark, folder):
    return ot.protocol_state_violation(ad.ot_events(spark, folder)).select(
        *BASE, F.col("evidence")["violation_type"].alias("violation_type"))
