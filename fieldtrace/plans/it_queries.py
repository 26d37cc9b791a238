"""Network detectors over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import it
from fieldtrace.plans import adapters as ad
from fieldtrace.plans import sqltext as st
from fieldtrace.plans.ot_queries import fact
from fieldtrace.plans.registry import query

SYN = "(tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0"


def rate_sql(cte, source, keys, window_us, limit, where="TRUE", extra="", out="n"):
    """Rows seen within the window in processing order, above a limit."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""WITH {cte}, w AS (SELECT * FROM {source} WHERE {where}),
c AS (SELECT b.*, (SELECT count(*) FROM w a WHERE {on} AND (a.ts_us, a.seq) <= (b.ts_us, b.seq) AND a.ts_us > b.ts_us - {window_us}) AS {out} FROM w b)
SELECT ts_us, seq, {extra}{out} FROM c WHERE {out} > {limit}"""


def scan_sql(window_us, ports, repeat_us=60_000_000):
    return f"""
WITH {ad.SG_SQL}, syn AS (SELECT * FROM sg WHERE {SYN}), {st.anchors('syn', 'src_ip', window_us)}, {st.windows('syn', 'src_ip')},
p AS (SELECT src_ip, mark_us, dst_port, min((ts_us, seq)) AS fs FROM win GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY src_ip, mark_us ORDER BY fs) AS n FROM p),
g AS (SELECT src_ip, mark_us, count(*) AS ports_scanned, max(fs) AS fs, list_sort(list(dst_port)) AS l FROM r WHERE n <= {ports + 1} GROUP BY ALL HAVING count(*) > {ports}),
hit AS (SELECT src_ip, ports_scanned, fs[1] AS ts_us, fs[2] AS seq,
 len(list_filter(list_transform(range(1, len(l)), lambda i: l[i + 1] - l[i]), lambda d: d = 1)) > ports_scanned * 0.3 AS s FROM g),
{st.kept('hit', 'src_ip', repeat_us)}
SELECT src_ip, ts_us, seq, ports_scanned, CASE WHEN s THEN 'sequential' ELSE 'random' END AS pattern FROM kept"""


def _scan(df):
    return df.select("src_ip", "ts_us", "seq", fact("ports_scanned"), F.col("evidence")["pattern"].alias("pattern"))


@query("port_scan_fast", scan_sql(60_000_000, 2))
def port_scan_fast(spark, folder):
    return _scan(it.port_scan(ad.segments(spark, folder), window_s=60, min_ports=2))


@query("port_scan_slow", scan_sql(300_000_000, 4))
def port_scan_slow(spark, folder):
    return _scan(it.port_scan_slow(ad.segments(spark, folder), min_ports=4))


@query("admin_port_attack", rate_sql(
    ad.SG_SQL, "sg", "src_ip, dst_ip, dst_port", 300_000_000, 1,
    f"{SYN} AND dst_port IN (22, 23, 3389, 445, 5900, 5985, 5986, 135, 139)",
    "src_ip, dst_ip, dst_port AS port, CASE WHEN dst_port IN (23, 3389) THEN 'CRITICAL' ELSE 'HIGH' END AS severity, ", "connection_count"))
def admin_port_attack(spark, folder):
    return it.admin_port_attack(ad.segments(spark, folder), limit=1).select(
        "ts_us", "seq", "src_ip", "dst_ip", "severity", fact("port"), fact("connection_count"))


@query("brute_force", rate_sql(ad.SG_SQL, "sg", "src_ip, dst_ip, dst_port", 300_000_000, 1, "(tcp_flags & 4) <> 0",
                               "src_ip, dst_ip, dst_port AS port, ", "failed_count"))
def brute_force(spark, folder):
    return it.brute_force(ad.segments(spark, folder), window_s=300, limit=1).select(
        "ts_us", "seq", "src_ip", "dst_ip", fact("port"), fact("failed_count"))


@query("lateral_movement", f"""
WITH {ad.SG_SQL}, w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, seq) = 1 THEN 1 ELSE 0 END AS f
 FROM sg WHERE {SYN} AND dst_port IN (445, 139, 135)),
c AS (SELECT *, CAST(sum(f) OVER (PARTITION BY src_ip ORDER BY ts_us, seq) AS BIGINT) AS targets_count FROM w)
SELECT ts_us, seq, src_ip, targets_count FROM c WHERE targets_count > 1""")
def lateral_movement(spark, folder):
    return it.lateral_movement(ad.segments(spark, folder), limit=1).select("ts_us", "seq", "src_ip", fact("targets_count"))


SUB = """sub AS (SELECT *, string_split(qname, '.') AS l FROM dn WHERE qname LIKE '%.%'),
dq AS (SELECT * EXCLUDE (l), CASE WHEN len(l) > 2 THEN array_to_string(l[1:len(l) - 2], '.') ELSE '' END AS subdomain,
 CASE WHEN len(l) > 2 THEN array_to_string(l[len(l) - 1:], '.') ELSE qname END AS domain FROM sub)"""


@query("dns_txt_rate", rate_sql(ad.DN_SQL + ", " + SUB, "dq", "src_ip", 60_000_000, 2, "qtype = 16",
                                "src_ip, domain, ", "txt_count"))
def dns_txt_rate(spark, folder):
    return it.dns_txt_rate(ad.dns_queries(spark, folder), limit=2).select(
        "ts_us", "seq", "src_ip", F.col("evidence")["domain"].alias("domain"), fact("txt_count"))


@query("dns_long_subdomain", f"""WITH {ad.DN_SQL}, {SUB} SELECT seq, src_ip, domain, CAST(length(subdomain) AS BIGINT) AS subdomain_length
FROM dq WHERE length(subdomain) > 50""")
def dns_long_subdomain(spark, folder):
    return it.dns_long_subdomain(ad.dns_queries(spark, folder)).select(
        "seq", "src_ip", F.col("evidence")["domain"].alias("domain"), fact("subdomain_length"))


@query("dns_entropy", f"""WITH {ad.DN_SQL}, {SUB}, e AS (SELECT seq, src_ip, subdomain, {st.ENTROPY.format(x='subdomain')} AS entropy
 FROM dq WHERE length(subdomain) > 10)
SELECT seq, src_ip, subdomain, round(entropy, 4) AS entropy FROM e WHERE entropy > 3.1""")
def dns_entropy(spark, folder):
    return it.dns_entropy(ad.dns_queries(spark, folder), min_entropy=3.1).select(
        "seq", "src_ip", F.col("evidence")["subdomain"].alias("subdomain"),
        F.round(F.col("evidence")["entropy"].cast("double"), 4).alias("entropy"))


@query("dns_subdomain_diversity", f"""
WITH {ad.DN_SQL}, {SUB}, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, domain, subdomain ORDER BY ts_us, seq) = 1 THEN 1 ELSE 0 END AS n FROM dq),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src_ip, domain ORDER BY ts_us, seq) AS BIGINT) AS unique_subdomains FROM f)
SELECT seq, src_ip, domain, unique_subdomains FROM c WHERE unique_subdomains > 8""")
def dns_subdomain_diversity(spark, folder):
    return it.dns_subdomain_diversity(ad.dns_queries(spark, folder), limit=8).select(
        "seq", "src_ip", F.col("evidence")["domain"].alias("domain"), fact("unique_subdomains"))


@query("arp_spoofing", f"""
WITH {ad.AR_SQL}, c AS (SELECT b.seq, b.ts_us, b.sender_ip, (SELECT count(DISTINCT a.sender_mac) FROM ar a WHERE a.sender_ip = b.sender_ip
 AND (a.ts_us, a.seq) <= (b.ts_us, b.seq) AND a.ts_us > b.ts_us - 30000000) AS macs FROM ar b)
SELECT seq, ts_us, sender_ip AS src_ip, macs FROM c WHERE macs > 1""")
def arp_spoofing(spark, folder):
    return it.arp_spoofing(ad.arp(spark, folder), window_s=30).select("seq", "ts_us", "src_ip", fact("macs"))


@query("gratuitous_arp", rate_sql(ad.AR_SQL, "ar", "sender_ip", 60_000_000, 2, "is_gratuitous",
                                  "sender_ip AS src_ip, sender_mac AS mac, ", "count"))
def gratuitous_arp(spark, folder):
    return it.gratuitous_arp(ad.arp(spark, folder), limit=2).select(
        "ts_us", "seq", "src_ip", F.col("evidence")["mac"].alias("mac"), fact("count"))


@query("arp_storm", rate_sql(ad.AR_SQL, "ar", "sender_ip", 10_000_000, 2, "TRUE", "sender_ip AS src_ip, ", "count"))
def arp_storm(spark, folder):
    return it.arp_storm(ad.arp(spark, folder), limit=2).select("ts_us", "seq", "src_ip", fact("count"))


FL = ad.FL_SQL


@query("exfil_large", f"WITH {FL} SELECT ts_us, src AS src_ip, dst AS dst_ip, bytes FROM fl WHERE bytes > 100000")
def exfil_large(spark, folder):
    return it.exfil_large(ad.flows(spark, folder), large_bytes=100_000).select("ts_us", "src_ip", "dst_ip", fact("bytes"))


@query("exfil_unusual_hours", f"""
WITH {FL}, c AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY src, dst ORDER BY ts_us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent,
 (ts_us // 3600000000) % 24 AS hour FROM fl)
SELECT ts_us, src AS src_ip, dst AS dst_ip, recent AS bytes, hour FROM c WHERE (hour >= 22 OR hour < 6) AND recent > 100000""")
def exfil_unusual_hours(spark, folder):
    return it.exfil_unusual_hours(ad.flows(spark, folder), window_s=7200, limit=100_000).select(
        "ts_us", "src_ip", "dst_ip", fact("bytes"), fact("hour"))


@query("exfil_hourly", f"""
WITH {FL}, c AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY src, dst, ts_us // 3600000000 ORDER BY ts_us) AS BIGINT) AS hourly FROM fl)
SELECT ts_us, src AS src_ip, dst AS dst_ip, hourly AS hourly_bytes FROM c WHERE hourly > 120000""")
def exfil_hourly(spark, folder):
    return it.exfil_hourly(ad.flows(spark, folder), limit=120_000).select(
        "ts_us", "src_ip", "dst_ip", fact("hourly_bytes"))


@query("exfiltration", f"""
WITH {FL}, c AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY src, dst ORDER BY ts_us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent,
 CAST(sum(bytes) OVER (PARTITION BY src, dst, ts_us // 3600000000 ORDER BY ts_us) AS BIGINT) AS hourly, (ts_us // 3600000000) % 24 AS hour FROM fl WHERE bytes > 1000),
t AS (SELECT *, CASE WHEN bytes > 102000 THEN 'DATA_EXFIL_LARGE_TRANSFER' WHEN (hour >= 22 OR hour < 6) AND recent > 95000 THEN 'DATA_EXFIL_UNUSUAL_HOURS'
 WHEN hourly > 120000 THEN 'DATA_EXFIL_CUMULATIVE' END AS anomaly_type FROM c)
SELECT ts_us, src AS src_ip, dst AS dst_ip, anomaly_type FROM t WHERE anomaly_type IS NOT NULL""")
def exfiltration(spark, folder):
    return it.exfiltration(ad.flows(spark, folder), large_bytes=102_000, recent_bytes=95_000,
                           hourly_bytes=120_000).select("ts_us", "src_ip", "dst_ip", "anomaly_type")


@query("c2_beacon", f"""
WITH {ad.SG_SQL}, syn AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, seq) AS rn FROM
  (SELECT seq, ts_us, src_ip, '' AS dst_ip, 0 AS dst_port, tcp_flags FROM sg) WHERE {SYN}),
n AS (SELECT *, CASE WHEN rn <= 20 THEN rn ELSE 12 + (rn - 21) % 9 END AS n FROM syn),
h AS (SELECT a.seq, a.ts_us, a.src_ip, a.n, list(b.ts_us ORDER BY b.rn) AS l FROM n a JOIN n b ON a.src_ip = b.src_ip AND b.rn BETWEEN a.rn - a.n + 1 AND a.rn
 WHERE a.n >= 5 AND a.n % 5 = 0 GROUP BY ALL),
s AS (SELECT *, list_transform(range(1, len(l)), lambda i: (l[i + 1] - l[i]) / 1e6) AS d FROM h),
m AS (SELECT *, list_avg(d) AS mean, list_stddev_pop(d) / list_avg(d) AS cv FROM s)
SELECT ts_us, seq, src_ip, n AS connection_count, round(mean, 4) AS mean_interval, round(cv, 4) AS cv,
 CASE WHEN cv < 0.8 THEN 'C2_BEACON_REGULAR' ELSE 'C2_BEACON_JITTER' END AS anomaly_type FROM m WHERE mean BETWEEN 5 AND 120 AND cv < 1.1""")
def c2_beacon(spark, folder):
    syn = ad.segments(spark, folder).withColumn("dst_ip", F.lit("")).withColumn("dst_port", F.lit(0))
    return it.c2_beacon(syn, min_count=5, keep=20, cut=12, regular=0.8, jitter=1.1, ranges=[(5, 120)]).select(
        "ts_us", "seq", "src_ip", "anomaly_type", fact("connection_count"),
        *[F.round(F.col("evidence")[c].cast("double"), 4).alias(c) for c in ("mean_interval", "cv")])
