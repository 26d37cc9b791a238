"""Detectors over HTTP requests and responses and over text in TCP payloads."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace import catalogue as cat
from fieldtrace.functions.content import decode_layers
from fieldtrace.functions.prefilter import possible_alternatives, required
from fieldtrace.functions.text import latin1, shannon_entropy, url_decode, url_decode2
from fieldtrace.operators.anchored import anchored, cooled
from fieldtrace.operators.shaping import alert
from fieldtrace.operators.sliced import numbered, rolling, running, seconds, spread


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ssrf_values(uri: Column, body: Column) -> Column:
    """URL-like parameter values only, joined by spaces."""
    values = F.regexp_extract_all(F.concat(uri, F.lit("&"), body),
                                  F.lit(r"(?i)(?:^|[?&=;,\s\"'])((?:[a-z][a-z0-9+.-]*:)?//[^&\s\"']+)"), F.lit(1))
    return F.array_join(values, " ")


def search_texts(requests: DataFrame) -> DataFrame:
    """Add the texts patterns look at: raw parts, decoded forms and URL values."""
    form = F.lower(_text("content_type")).contains("urlencoded") | (_text("content_type") == "")
    return (requests.withColumn("_uri", _text("uri")).withColumn("_body", _text("body")).withColumn("_headers", _text("headers_raw"))
            .withColumn("_uri2", url_decode2(F.col("_uri")))
            .withColumn("_body2", F.when(form, url_decode2(F.col("_body"))).otherwise(F.lit("")))
            .withColumn("_url_values", ssrf_values(F.col("_uri"), F.col("_body"))).withColumn("_user_agent", _text("user_agent")))


# where each kind of target is looked for, in order
_PLACES = {"uri": ["_uri", "_uri2"], "body": ["_body", "_body2"], "headers": ["_headers"], "url_values": ["_url_values"],
           "user_agent": ["_user_agent"]}


def _hit(pattern: cat.Pattern, place: int) -> Column:
    """What a hit of the pattern means; alternatives are run only where their literals occur."""
    always = [a for a in pattern.alternatives if not required(a)]
    rest = replace(pattern, alternatives=tuple(always)).regex if always else None
    here = F.get("_possible", F.lit(place))

    def test(c: str) -> Column:
        sure = F.when(here.isNotNull(), F.rlike(F.col(c), here)).otherwise(F.lit(False))
        return F.col(c).rlike(rest) | sure if rest else sure
    found = F.coalesce(*[F.when(test(c), F.lit(t)) for t in pattern.targets for c in _PLACES[t]])
    allowed = F.upper("method").isin(list(pattern.methods)) if pattern.methods else F.lit(True)
    return F.when(allowed & found.isNotNull(), F.struct(
        F.lit(pattern.category).alias("category"), F.lit(pattern.severity).alias("severity"), found.alias("found_in"),
        F.array(*[F.lit(m) for m in pattern.mitre]).alias("mitre")))


def http_pattern_rules(requests: DataFrame, patterns: list[cat.Pattern] | None = None) -> DataFrame:
    """One alert per request and category of the catalogue that matches anywhere it may.

    One pass over a request's texts finds the literals of all patterns; only alternatives whose literals occur are
    evaluated, so the cost follows the hits and not the size of the catalogue.
    """
    patterns = patterns or cat.HTTP_CATALOGUE
    rows = search_texts(requests)
    texts = F.concat_ws("\n", "_uri", "_uri2", "_body", "_body2", "_headers", "_user_agent")
    rows = rows.withColumn("_possible", possible_alternatives(texts, [("(?i)" if p.ignore_case else "", p.alternatives) for p in patterns]))
    rows = rows.withColumn("_hit", F.explode(F.array_compact(F.array(*[_hit(p, i) for i, p in enumerate(patterns)]))))
    category = F.col("_hit.category")
    confidence = (F.when(category == "SUSPICIOUS_USER_AGENT", 0.95).when(category == "HEADER_ANOMALY", 0.75)
                  .when(category.contains("WEBSHELL") & (F.col("_hit.found_in") == "body"), 0.90)
                  .when(category.contains("OBFUSCATION"), 0.80).otherwise(0.85))
    return alert(rows, F.concat(F.lit("HTTP_"), category), F.col("_hit.severity"), protocol=F.lit("HTTP"),
                 mitre=F.col("_hit.mitre"), confidence=confidence,
                 evidence={"found_in": F.col("_hit.found_in"), "uri": F.col("_uri"), "method": F.col("method")})


def scanner_name(user_agent: Column) -> Column:
    text = F.lower(user_agent)
    return F.coalesce(*[F.when(text.contains(w), F.lit(n)) for w, n in cat.SCANNERS], F.lit("Unknown Scanner"))


def scanner_user_agent(requests: DataFrame) -> DataFrame:
    """Requests of known attack tools, with the tool's name."""
    pattern = next(p for p in cat.HTTP_CATALOGUE if p.category == "SUSPICIOUS_USER_AGENT")
    rows = requests.where(_text("user_agent").rlike(pattern.regex))
    return alert(rows, "HTTP_SUSPICIOUS_USER_AGENT", "MEDIUM", protocol=F.lit("HTTP"), mitre=["T1595"], confidence=0.95,
                 evidence={"tool": scanner_name(F.col("user_agent")), "user_agent": F.col("user_agent")})


def http_rapid_requests(requests: DataFrame, window_s: float = 60.0, limit: int = 80, high: int = 150, repeat_s: float = 60.0) -> DataFrame:
    rows = rolling(requests.select("ts_us", "seq", "src_ip", "dst_ip", "dst_port"), ["src_ip", "dst_ip", "dst_port"],
                   seconds(window_s), {"n": ("count", None)}).where(F.col("n") > limit)
    rows = cooled(rows, ["src_ip", "dst_ip"], seconds(repeat_s))
    return alert(rows, "HTTP_RAPID_REQUESTS", F.when(F.col("n") > high, "HIGH").otherwise("MEDIUM"), protocol=F.lit("HTTP"),
                 mitre=["T1595", "T1110"], confidence=F.when(F.col("n") > high, 0.75).otherwise(0.60), evidence={"request_count": F.col("n")})


def http_dangerous_method(requests: DataFrame) -> DataFrame:
    rows = requests.where(F.col("method").isin("PUT", "DELETE", "CONNECT"))
    return alert(rows, "HTTP_DANGEROUS_METHOD", "HIGH", protocol=F.lit("HTTP"), mitre=["T1190"], confidence=0.75,
                 evidence={"method": F.col("method"), "uri": F.col("uri")})


def http_sensitive_file(requests: DataFrame) -> DataFrame:
    found = F.coalesce(*[F.when(F.lower("uri").contains(e), F.lit(e)) for e in cat.SENSITIVE_EXTENSIONS])
    rows = requests.withColumn("_ext", found).where("_ext IS NOT NULL")
    return alert(rows, "HTTP_SENSITIVE_FILE_ACCESS", "MEDIUM", protocol=F.lit("HTTP"), mitre=["T1083", "T1005"], confidence=0.75,
                 evidence={"uri": F.col("uri"), "extension": F.col("_ext")})


def directory_bruteforce(responses: DataFrame, window_s: float = 120.0, min_total: int = 20, strong: tuple = (30, 0.7),
                         weak: tuple = (15, 0.6), repeat_s: float = 120.0) -> DataFrame:
    """Clients collecting errors: running counts within windows anchored at a client's first response."""
    keys = ["client_ip", "server_ip", "server_port"]
    rows = anchored(responses.select("ts_us", "seq", "status", *keys), keys, seconds(window_s), strict=True)
    upto = Window.partitionBy(*keys, "mark_us").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    error = F.col("status").isin(400, 401, 403, 404, 405, 500)
    rows = (rows.withColumn("total", F.count(F.lit(1)).over(upto)).withColumn("errors", F.sum(error.cast("long")).over(upto))
            .withColumn("missing", F.sum((F.col("status") == 404).cast("long")).over(upto)))
    ratio = F.col("errors") / F.col("total")
    hard = (F.col("missing") >= strong[0]) & (ratio > strong[1])
    soft = (F.col("missing") >= weak[0]) & (ratio > weak[1])
    fired = cooled(rows.where((F.col("total") >= min_total) & (hard | soft)), keys, seconds(repeat_s))
    return alert(fired, "HTTP_DIRECTORY_BRUTEFORCE", F.when(hard, "HIGH").otherwise("MEDIUM"), src="client_ip", dst="server_ip",
                 protocol=F.lit("HTTP"), mitre=["T1595.003", "T1083"], confidence=F.when(hard, 0.92).otherwise(0.80),
                 evidence={"total_responses": F.col("total"), "404_count": F.col("missing"), "error_count": F.col("errors")})


def post_exploitation(segments: DataFrame, patterns: list[cat.Pattern] | None = None, min_bytes: int = 10,
                      max_binary: float = 0.3, repeat_s: float = 300.0) -> DataFrame:
    """Shell activity in text payloads, once per category and pair of hosts in five minutes.

    The whole payload is searched. Mostly unprintable payloads are skipped, and one
    expression over all categories decides first whether any can match.
    """
    patterns = patterns or cat.POST_EXPLOITATION
    rows = segments.where(F.octet_length("payload") >= min_bytes).withColumn("_t", latin1(F.col("payload")))
    printable = F.length(F.regexp_replace("_t", r"[^\x20-\x7e\t\r\n]", ""))
    rows = rows.where((F.length("_t") - printable <= F.length("_t") * max_binary)
                      & F.col("_t").rlike("|".join(p.regex for p in patterns)))
    hits = F.array_compact(F.array(*[F.when(F.col("_t").rlike(p.regex), F.struct(
        F.lit(p.category).alias("category"), F.lit(p.severity).alias("severity"),
        F.array(*[F.lit(m) for m in p.mitre]).alias("mitre"), F.regexp_extract("_t", f"({p.regex})", 1).alias("text"))) for p in patterns]))
    rows = (rows.withColumn("_hit", F.explode(hits)).withColumn("category", F.col("_hit.category"))
            .withColumn("_a", F.least("src_ip", "dst_ip")).withColumn("_b", F.greatest("src_ip", "dst_ip"))
            .select("ts_us", "seq", "src_ip", "dst_ip", "category", "_a", "_b", "_hit"))
    fired = cooled(rows, ["category", "_a", "_b"], seconds(repeat_s))
    return alert(fired, F.concat(F.lit("POST_EXPLOIT_"), F.col("category")), F.col("_hit.severity"), protocol=F.lit("TCP"),
                 mitre=F.col("_hit.mitre"), confidence=0.90, evidence={"category": F.col("category"), "matched": F.col("_hit.text")})


# --------------------------------------------------------------------------- payloads

def _count(texts: list[Column], words: list[str], lower: bool) -> Column:
    total = F.lit(0)
    for word in words:
        seen = F.lit(False)
        for t in texts:
            seen = seen | (F.lower(t) if lower else t).contains(word)
        total = total + seen.cast("int")
    return total


def http_payload_score(requests: DataFrame) -> DataFrame:
    """Score a request body 0-100 from known shells, functions, commands, layers and uploads.

    Decoded layers are searched as well as the body, each as a whole.
    """
    rows = requests.where(F.length(_text("body")) > 0).withColumn("_raw", F.encode("body", "UTF-8"))
    rows = rows.withColumn("_d", decode_layers(F.col("_raw"), "attempt")).withColumn("_layers", F.size("_d.steps"))
    rows = rows.withColumn("_inner", F.when(F.col("_layers") > 0, latin1(F.col("_d.data"))).otherwise(F.lit("")))
    body, inner = F.col("body"), F.col("_inner")
    both = [body, inner]
    shells = _count([body], [w for words in cat.KNOWN_WEBSHELLS.values() for w in words], True)
    php = {k: _count(both, v, False) for k, v in cat.PHP_FUNCTIONS.items()}
    commands = {k: _count(both, v, True) for k, v in cat.SHELL_COMMANDS.items()}
    upload = F.lower(_text("content_type")).contains("multipart/form-data")
    head = F.hex(F.substring("_raw", 1, 4))
    binary = F.lit(False)
    for magic in cat.BINARY_MAGIC:
        binary = binary | head.startswith(magic)
    post = F.col("method") == "POST"
    threats = shells + sum(php.values(), F.lit(0)) + sum(commands.values(), F.lit(0)) + binary.cast("int")
    threats = threats + F.when(upload, _count([body], cat.UPLOAD_EXTENSIONS, True)
                               + body.rlike(r'(?i)filename="[^\r\n]*\.(jpg|png|gif)\.(php|jsp|aspx)"').cast("int")
                               + (body.contains("\x00") & body.contains("filename=")).cast("int")).otherwise(0)
    threats = threats + F.when(post, _count([F.col("uri")], cat.POST_PATHS, True) + (F.octet_length("_raw") > 1_000_000).cast("int")).otherwise(0)
    threats = threats + ((F.octet_length("_raw") > 100) & (shannon_entropy(F.col("_raw")) > 7.5)).cast("int")
    hidden = sum((F.when(F.col("_layers") > 0, inner.rlike(p).cast("int")).otherwise(0) for p in (
        r"\$\$[a-zA-Z_]", r"chr\s*\(\s*\d+\s*\)\s*\.\s*chr\s*\(\s*\d+\s*\)", r"(\\x[0-9a-fA-F]{2}){3}", r"eval\s*\(\s*[$a-zA-Z_][\w$]*\s*\(")), F.lit(0))
    threats = threats + hidden
    score = F.when(shells > 0, 80).otherwise(0) + F.col("_layers") * 15 + F.when(upload, 20).otherwise(0) + F.when(binary, 25).otherwise(0)
    for level, n in php.items():
        score = score + n * cat.PHP_POINTS[level]
    for level, n in commands.items():
        score = score + n * cat.COMMAND_POINTS[level]
    total = F.least(F.lit(100), score + threats * 5)
    return (rows.withColumn("threats", threats.cast("long")).withColumn("score", total.cast("long")).withColumn("layers", F.col("_layers").cast("long"))
            .withColumn("level", F.when(F.col("score") >= 80, "CRITICAL").when(F.col("score") >= 60, "HIGH").when(F.col("score") >= 40, "MEDIUM")
                        .when(F.col("score") >= 20, "LOW").otherwise("NONE")).drop("_raw", "_d", "_layers", "_inner"))


def payload_type(data: Column) -> Column:
    """Struct of type, risk and matched patterns of a payload's bytes."""
    t = latin1(data)
    hits = F.array_compact(F.array(*[F.when(t.rlike("(?i)" + p), F.lit(n)) for p, n in cat.PAYLOAD_PATTERNS]))
    head = F.hex(F.substring(data, 1, 4))
    kind = (F.when(F.size(hits) > 0, "WEBSHELL").when(t.rlike(r"(?i)<\?php"), "PHP_SCRIPT").when(t.rlike("<%.*%>"), "JSP_SCRIPT")
            .when(t.rlike("(?i)<script"), "JAVASCRIPT").when(head == "7F454C46", "ELF_BINARY").when(head.startswith("4D5A"), "PE_BINARY")
            .otherwise("UNKNOWN"))
    risk = (F.when(kind.isin("WEBSHELL", "ELF_BINARY", "PE_BINARY"), "CRITICAL").when(kind.isin("PHP_SCRIPT", "JSP_SCRIPT"), "HIGH")
            .when(kind == "JAVASCRIPT", "MEDIUM").otherwise("LOW"))
    return F.struct(kind.alias("type"), risk.alias("risk"), hits.alias("patterns"))


def http_payload_type(requests: DataFrame) -> DataFrame:
    data = F.encode(_text("body"), "UTF-8")
    return (requests.withColumn("_p", payload_type(data)).withColumn("sha256", F.sha2(data, 256))
            .withColumn("payload_type", F.col("_p.type")).withColumn("risk", F.col("_p.risk"))
            .withColumn("patterns", F.col("_p.patterns")).drop("_p"))


def http_decoded_alert(messages: DataFrame, min_layers: int = 3) -> DataFrame:
    """Alerts on complete messages whose decoded body is dangerous or was wrapped several times.

    ``messages`` come from :func:`fieldtrace.operators.http.decode_http_message`.
    """
    rows = messages.where(F.octet_length("body_final") >= 10).withColumn("_p", payload_type(F.col("body_final")))
    layers = F.size("decode_steps")
    bad = rows.where(F.col("_p.risk").isin("CRITICAL", "HIGH"))
    kind = F.concat(F.lit("HTTP_DECODED_"), F.col("_p.type"))
    facts = {"decode_layers": layers, "sha256": F.sha2("body_final", 256), "final_size": F.octet_length("body_final")}
    shell = F.when(F.col("_p.type").contains("WEBSHELL"), F.array(F.lit("T1505.003"), F.lit("T1027"))).otherwise(F.array(F.lit("T1027")))
    one = alert(bad, kind, F.col("_p.risk"), protocol=F.lit("HTTP"), mitre=shell,
                confidence=F.when(layers > 0, 0.90).otherwise(0.85), evidence=facts)
    two = alert(rows.where(layers >= min_layers), "HTTP_MULTILAYER_ENCODING", "HIGH", protocol=F.lit("HTTP"),
                mitre=["T1027", "T1140"], confidence=0.80, evidence=facts)
    return one.unionByName(two)


# --------------------------------------------------------------------------- request streams

def _threat(rows: DataFrame, kind, severity, confidence, mitre, evidence=None) -> DataFrame:
    return alert(rows, kind, severity, protocol=F.lit("HTTP"), confidence=confidence, mitre=mitre,
                 evidence={"uri": F.col("uri"), **(evidence or {})})


def webshell_access(requests: DataFrame, languages: dict[str, tuple[list[str], int]] | None = None) -> DataFrame:
    """Requests for the file of a known shell, or whose body runs commands in one of the languages."""
    kinds = F.when(_text("uri").rlike(cat.WEBSHELL_FILES), "WEBSHELL_ACCESS")
    for language, (patterns, least) in (languages or cat.EXECUTION).items():
        found = sum((_text("body").rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0))
        kinds = kinds.when(found >= least, f"WEBSHELL_EXECUTION_{language}")
    rows = requests.withColumn("_kind", kinds).where("_kind IS NOT NULL")
    return _threat(rows, F.col("_kind"), "CRITICAL", F.when(F.col("_kind") == "WEBSHELL_ACCESS", 0.95).otherwise(0.90), ["T1505.003", "T1059.004"])


def dangerous_upload(requests: DataFrame) -> DataFrame:
    """Multipart uploads of scripts or programs; content that starts like one is worse."""
    rows = requests.where((F.col("method") == "POST") & F.lower(_text("content_type")).contains("multipart/form-data"))
    name = F.regexp_extract(_text("body"), r"(?i)filename\s*=\s*[\"']?([^\"';\r\n]+)", 1)
    rows = rows.withColumn("filename", name).where(F.col("filename") != "")
    rows = rows.where(F.trim("filename").rlike(cat.DANGEROUS_NAME) | F.col("filename").rlike(cat.DOUBLE_NAME) | F.col("filename").rlike(cat.NULL_NAME))
    content = F.regexp_extract(_text("body"), r"(?is)filename\s*=.*?\r\n\r\n(\x7fELF|MZ|<\?php|<%@)", 1)
    rows = rows.withColumn("_magic", content != "")
    return _threat(rows, F.when(F.col("_magic"), "FILE_UPLOAD_DANGEROUS").otherwise("FILE_UPLOAD_SUSPICIOUS"),
                   F.when(F.col("_magic"), "CRITICAL").otherwise("HIGH"), F.when(F.col("_magic"), 0.92).otherwise(0.80),
                   ["T1505.003", "T1105"], {"filename": F.col("filename")})


def http_command_execution(requests: DataFrame) -> DataFrame:
    raw = F.concat(_text("uri"), F.lit(" "), _text("body"))
    decoded = url_decode(raw)
    text = F.when(decoded == raw, raw).otherwise(F.concat(raw, F.lit(" "), decoded))
    rows = requests.withColumn("commands", F.regexp_extract_all(text, F.lit(cat.COMMANDS), F.lit(1))).where(F.size("commands") > 0)
    serious = F.lit(False)
    for word in cat.SERIOUS_COMMANDS:
        serious = serious | F.lower(F.array_join("commands", "\n")).contains(word)
    return _threat(rows, "COMMAND_EXECUTION_HTTP", F.when(serious, "CRITICAL").otherwise("MEDIUM"), 0.88, ["T1059", "T1505.003"],
                   {"commands": F.array_join("commands", ","), "count": F.size("commands")})


def http_reverse_shell(requests: DataFrame) -> DataFrame:
    rows = requests.where(_text("body").rlike(cat.REVERSE_SHELL))
    target = F.regexp_extract("body", r"(\d+\.\d+\.\d+\.\d+:\d+)", 1)
    return _threat(rows, "REVERSE_SHELL_HTTP", "CRITICAL", 0.95, ["T1071.001", "T1059"],
                   {"c2_target": F.when(target != "", target).otherwise("unknown")})


def http_obfuscation(requests: DataFrame, min_hits: int = 2, min_entropy: float = 7.0) -> DataFrame:
    rows = requests.where(_text("body") != "")
    hits = (F.regexp_count("body", F.lit(cat.OBFUSCATION)) + F.col("body").rlike(r"(?i)eval\s*\(\s*base64_decode").cast("int")
            + F.col("body").rlike(r"(?i)eval\s*\(\s*gzinflate").cast("int"))
    rows = rows.withColumn("_n", hits).withColumn("_e", shannon_entropy(F.encode("body", "UTF-8")))
    rows = rows.where((F.col("_n") >= min_hits) | (F.col("_e") > min_entropy))
    return _threat(rows, "OBFUSCATED_PAYLOAD_HTTP", "HIGH", 0.85, ["T1027", "T1140"], {"hits": F.col("_n"), "entropy": F.col("_e")})


def http_request_burst(requests: DataFrame, last: int = 20, min_requests: int = 5, rate: float = 5.0, max_uris: int = 3) -> DataFrame:
    """The last requests of a source come fast and go to few URIs.

    At the given rate ``last`` requests span less than ``last / rate`` seconds, so a
    slice with that much overlap sees every frame that can fire.
    """
    span = seconds(last / rate)
    ranked = numbered(requests.select("ts_us", "seq", "src_ip", "dst_ip", "uri"), ["src_ip"])
    rows = spread(ranked, "ts_us", span, max(20 * span, seconds(60)))
    frame = Window.partitionBy("src_ip", "_slice").orderBy("ts_us", "seq").rowsBetween(-(last - 1), 0)
    rows = (rows.withColumn("n", F.count(F.lit(1)).over(frame)).withColumn("span", F.col("ts_us") - F.min("ts_us").over(frame))
            .withColumn("uris", F.size(F.collect_set("uri").over(frame))))
    fired = rows.where((F.col("_slice") == F.col("_own")) & (F.col("n") == F.least("rn", F.lit(last))) & (F.col("n") >= min_requests)
                       & (F.col("span") > 0) & (F.col("n") / (F.col("span") / 1e6) > rate) & (F.col("uris") < max_uris))
    return _threat(fired, "RAPID_HTTP_REQUESTS", "MEDIUM", 0.75, ["T1595"], {"requests": F.col("n"), "unique_uris": F.col("uris")})


def request_threats(requests: DataFrame) -> DataFrame:
    """All request-stream detectors, in the order they are judged for one request."""
    parts = [webshell_access(requests), dangerous_upload(requests), http_command_execution(requests), http_reverse_shell(requests),
             http_obfuscation(requests), http_request_burst(requests)]
    out = None
    for rank, part in enumerate(parts):
        part = part.withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out


def webshell_sequence(requests: DataFrame, threats: DataFrame, last: int = 10) -> DataFrame:
    """Requests at which upload, access and command are among the source's last threats.

    A request is judged after its own threats. Each threat is dealt to the ``last``
    positions it is still recent for, so a busy source is spread over as many groups
    as it has threats, and a request looks its position up.
    """
    rows = threats.withColumn("_sub", F.col("seq") * 8 + F.col("_rank"))
    rows = numbered(rows.select("ts_us", "_sub", "seq", "src_ip", "anomaly_type"), ["src_ip"], ts="ts_us", seq="_sub")
    dealt = rows.select("src_ip", "anomaly_type", F.explode(F.sequence(F.col("rn"), F.col("rn") + (last - 1))).alias("position"))

    def seen(*words):
        test = F.lit(False)
        for word in words:
            test = test | F.col("anomaly_type").contains(word)
        return F.max(test.cast("int"))
    recent = dealt.groupBy("src_ip", "position").agg(
        seen("UPLOAD").alias("u"), seen("WEBSHELL_ACCESS", "EXECUTION").alias("a"), seen("COMMAND").alias("c")).where("u = 1 AND a = 1 AND c = 1")
    own = threats.groupBy("src_ip", "ts_us", "seq").agg(F.count(F.lit(1)).alias("_n"))
    asked = requests.select("ts_us", "seq", "src_ip", "dst_ip").join(own, ["src_ip", "ts_us", "seq"], "left")
    asked = running(asked, ["src_ip"], {"position": ("sum", F.coalesce("_n", F.lit(0)))})
    fired = asked.where("position >= 3").join(recent, ["src_ip", "position"])
    return alert(fired, "ATTACK_CHAIN_WEBSHELL", "CRITICAL", protocol=F.lit("HTTP"), confidence=0.95,
                 mitre=["T1505.003", "T1059", "T1105"], evidence={"attack_stages": F.col("position")})


def http_attacker_summary(requests: DataFrame, threats: DataFrame) -> DataFrame:
    """Requests, uploads, commands and threats per source with a level."""
    asked = requests.groupBy("src_ip").agg(F.count(F.lit(1)).alias("requests"))
    kind = F.col("anomaly_type")
    did = threats.groupBy("src_ip").agg(
        F.count_if(kind.contains("UPLOAD")).alias("uploads"),
        F.coalesce(F.sum(F.when(kind == "COMMAND_EXECUTION_HTTP", F.col("evidence")["count"].cast("long"))), F.lit(0)).alias("commands"),
        F.count(F.lit(1)).alias("threats"))
    rows = asked.join(did, "src_ip", "left").fillna(0, ["uploads", "commands", "threats"])
    u, c = F.col("uploads") > 0, F.col("commands")
    return rows.withColumn("threat_level", F.when((u & (c > 0)) | (c > 5), "CRITICAL").when(u | (c > 0), "HIGH")
                           .when(F.col("threats") > 10, "MEDIUM").otherwise("LOW"))
