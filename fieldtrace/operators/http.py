"""HTTP messages from TCP segments: parsing, reassembly, completeness, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace import dims
from fieldtrace.functions.content import decode_body
from fieldtrace.functions.text import latin1, utf8
from fieldtrace.operators.connections import CONNECTION, IDLE_S, connections
from fieldtrace.operators.sliced import running

HTTP_PORTS = [80, 8080, 8000, 8888]
METHODS = "GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE"
START = rf"^(?:(?:{METHODS})\s+\S+|HTTP/\d\.\d\s+\d{{3}})"
BODYLESS = ["GET", "HEAD", "OPTIONS", "DELETE", "CONNECT", "TRACE"]
STREAM_SLICE = 1 << 26      # bytes of a stream that are ordered together


def http_segments(segments: DataFrame) -> DataFrame:
    """Segments with payload to or from a cleartext web port."""
    return segments.where((F.octet_length("payload") > 0) & (F.col("dst_port").isin(HTTP_PORTS) | F.col("src_port").isin(HTTP_PORTS)))


def reassembly_stats(segments: DataFrame, idle_s: float = IDLE_S) -> DataFrame:
    """Segments, retransmissions, out-of-order arrivals and gaps per connection and direction."""
    rows = connections(segments, idle_s).where(F.octet_length("payload") > 0).select(
        *CONNECTION, "position", "ts_us", "seq", F.octet_length("payload").cast("long").alias("size"))
    total = rows.groupBy(*CONNECTION).agg(F.count(F.lit(1)).alias("segments"))
    first = rows.groupBy(*CONNECTION, "position").agg(F.min(F.struct("ts_us", "seq", "size")).alias("f")).select(*CONNECTION, "position", "f.*")
    first = first.withColumn("end", F.col("position") + F.col("size"))
    arrived = running(first, CONNECTION, {"_expected": ("past_max", F.col("end"))})
    early = arrived.groupBy(*CONNECTION).agg(F.count_if(F.col("_expected").isNotNull() & (F.col("position") != F.col("_expected"))).alias("out_of_order"))
    ordered = running(first, CONNECTION, {"_prev_end": ("prev", F.col("end"))}, ts="position", seq="seq", width=STREAM_SLICE)
    gaps = ordered.groupBy(*CONNECTION).agg(F.count(F.lit(1)).alias("unique"), F.sum("size").alias("stream_size"),
                                            F.count_if(F.col("position") > F.col("_prev_end")).alias("missing_segments"))
    out = total.join(gaps, CONNECTION).join(early, CONNECTION)
    return out.withColumn("retransmissions", F.col("segments") - F.col("unique")).drop("unique")


def reassemble_http(segments: DataFrame, idle_s: float = IDLE_S) -> DataFrame:
    """One row per HTTP message: the bytes of its segments in sequence order.

    Every connection of a direction (see :func:`connections`) is put in order by itself. Duplicates go first (first arrival
    wins), overlaps are trimmed against the furthest byte seen before, and a chunk that opens with a request or
    status line starts a new message. Only the chunks of one message ever meet in a group.
    """
    key = [*CONNECTION, "started_us"]
    first = connections(segments, idle_s).where(F.octet_length("payload") > 0).groupBy(*key, "position").agg(
        F.min_by(F.struct("ts_us", "seq", "payload"), F.struct("ts_us", "seq")).alias("f")).select(*key, "position", "f.*")
    first = first.withColumn("_end", F.col("position") + F.octet_length("payload"))
    rows = running(first, key, {"_reach": ("past_max", F.col("_end"))}, ts="position", seq="seq", width=STREAM_SLICE)
    skip = F.greatest(F.coalesce(F.col("_reach") - F.col("position"), F.lit(0)), F.lit(0))
    rows = rows.withColumn("_skip", skip).where(F.col("_skip") < F.octet_length("payload")).withColumn(
        "chunk", F.expr("substring(payload, CAST(_skip AS INT) + 1)"))
    begins = latin1(F.col("chunk")).rlike(START)
    rows = rows.withColumn("_start", begins.cast("long"))
    rows = running(rows, key, {"message_no": ("sum", F.col("_start"))}, ts="position", seq="seq", width=STREAM_SLICE)
    parts = F.array_sort(F.collect_list(F.struct("position", latin1(F.col("chunk")).alias("t"))))
    return rows.groupBy(*key, "message_no").agg(
        F.min("ts_us").alias("ts_us"), F.max("ts_us").alias("last_us"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("chunks"),
        F.encode(F.array_join(F.transform(parts, lambda p: p["t"]), ""), "ISO-8859-1").alias("data"))


def headers_map(head: Column) -> Column:
    """Lower-cased header names; a repeated name keeps its last value."""
    lines = F.filter(F.split(head, "\r?\n"), lambda x: x.contains(":"))
    pairs = F.array_sort(F.transform(lines, lambda x, i: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), i.alias("i"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))))
    # the inner lambda makes the sorted pairs once, not once per header
    last = F.transform(F.array(pairs), lambda all_: F.filter(all_, lambda p, j: F.coalesce(F.get(all_, j + 1)["k"] != p["k"], F.lit(True))))[0]
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))


def _split_message(rows: DataFrame, text: str) -> DataFrame:
    """Head, body offset and first line of the message text."""
    t = F.col(text)
    crlf, lf = F.instr(t, "\r\n\r\n"), F.instr(t, "\n\n")
    at = F.when(crlf > 0, crlf).otherwise(lf)
    rows = rows.withColumn("_at", at).withColumn("_skip", F.when(crlf > 0, 4).otherwise(2))
    rows = rows.withColumn("_head", F.when(F.col("_at") > 0, F.expr(f"substring({text}, 1, _at - 1)")))
    return rows.withColumn("_line", F.substring_index(F.regexp_replace("_head", "\r", ""), "\n", 1)).withColumn(
        "_fields", F.regexp_replace("_head", "^[^\n]*\n?", ""))


def parse_http_request(segments: DataFrame) -> DataFrame:
    """Requests that start in a segment: method, target, headers and the body so far, whole."""
    rows = segments.withColumn("_text", utf8(F.col("payload")))
    rows = rows.withColumn("method", F.upper(F.regexp_extract("_text", r"^(\w+) ", 1))).where(F.col("method").isin(list(dims.HTTP_METHODS)))
    rows = rows.withColumn("uri", F.regexp_extract("_text", r"^\w+ ([^ \r\n]+)", 1)).where(F.col("uri") != "")
    rows = rows.withColumn("version", F.regexp_extract("_text", r"^\w+ [^ \r\n]+ ([^ \r\n]+)", 1))
    at = F.instr("_text", "\r\n\r\n")
    rows = rows.withColumn("_at", at)
    rows = rows.withColumn("headers_raw", F.when(F.col("_at") > 0, F.expr("substring(_text, instr(_text, '\\r\\n') + 2, greatest(_at - instr(_text, '\\r\\n') - 2, 0))"))
                           .otherwise(F.regexp_replace("_text", "^[^\r\n]*(\r\n)?", "")))
    rows = rows.withColumn("body", F.when(F.col("_at") > 0, F.expr("substring(_text, _at + 4)")).otherwise(""))
    rows = rows.withColumn("headers", headers_map(F.col("headers_raw")))
    h = F.col("headers")
    return (rows.withColumn("host", F.coalesce(h["host"], F.lit(""))).withColumn("user_agent", F.coalesce(h["user-agent"], F.lit("")))
            .withColumn("content_type", F.coalesce(h["content-type"], F.lit("")))
            .withColumn("content_length", F.coalesce(h["content-length"].cast("long"), F.lit(0)))
            .withColumn("operation_type", dims.lookup(dims.HTTP_METHODS, F.col("method"), lambda v: v[0], F.lit("UNKNOWN")))
            .withColumn("risk_level", dims.lookup(dims.HTTP_METHODS, F.col("method"), lambda v: v[1], F.lit("MEDIUM")))
            .drop("_text", "_at"))


def decode_http_message(messages: DataFrame) -> DataFrame:
    """Reassembled messages with line, headers, completeness and decoded body."""
    rows = _split_message(messages.withColumn("_text", latin1(F.col("data"))), "_text")
    line = F.col("_line")
    request = line.rlike(rf"^(?:{METHODS})\s+\S+\s+HTTP/\d\.\d")
    response = line.rlike(r"^HTTP/\d\.\d\s+\d{3}")
    rows = rows.withColumn("kind", F.when(request, "request").when(response, "response").otherwise("unknown"))
    rows = (rows.withColumn("method", F.when(request, F.regexp_extract(line, r"^(\w+)", 1)).otherwise(""))
            .withColumn("uri", F.when(request, F.regexp_extract(line, r"^\w+\s+(\S+)", 1)).otherwise(""))
            .withColumn("status", F.when(response, F.regexp_extract(line, r"^HTTP/\d\.\d\s+(\d{3})", 1).cast("int")).otherwise(0))
            .withColumn("headers", F.coalesce(headers_map(F.col("_fields")), F.create_map().cast("map<string,string>")))
            .withColumn("headers_raw", F.coalesce("_fields", F.lit(""))))
    rows = rows.withColumn("body_raw", F.when(F.col("_at") > 0, F.expr("substring(data, _at + _skip)")))
    h = F.col("headers")
    length = F.when(h["content-length"].rlike("^[0-9]+$"), h["content-length"].cast("long"))
    rows = (rows.withColumn("content_length", length)
            .withColumn("is_chunked", F.lower(F.coalesce(h["transfer-encoding"], F.lit(""))).contains("chunked"))
            .withColumn("content_encoding", F.lower(F.coalesce(h["content-encoding"], F.lit(""))))
            .withColumn("content_type", F.coalesce(h["content-type"], F.lit(""))).withColumn("host", F.coalesce(h["host"], F.lit("")))
            .withColumn("user_agent", F.coalesce(h["user-agent"], F.lit(""))))
    got = F.coalesce(F.octet_length("body_raw"), F.lit(0))
    rows = rows.withColumn("_d", decode_body("body_raw", "is_chunked", "content_encoding"))
    complete = (F.when(F.col("_at") <= 0, F.lit(False))
                .when(F.col("method").isin(BODYLESS) & F.col("content_length").isNull() & ~F.col("is_chunked"), F.lit(True))
                .when((F.col("kind") == "response") & F.col("content_length").isNull() & ~F.col("is_chunked")
                      & ((F.col("status") < 200) | F.col("status").isin(204, 304)), F.lit(True))
                .when(F.col("is_chunked"), F.col("_d.ended")).when(F.col("content_length").isNotNull(), got >= F.col("content_length"))
                .otherwise(got > 0))
    rows = rows.withColumn("is_complete", complete)
    return (rows.withColumn("body_final", F.col("_d.data")).withColumn("decode_steps", F.col("_d.steps"))
            .withColumn("body", utf8(F.col("body_final")))
            .drop("_text", "_at", "_skip", "_head", "_line", "_fields", "_d"))
