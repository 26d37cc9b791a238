"""HTTP connections, completeness and headers on hand-made segments."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.functions.content import dechunk
from fieldtrace.operators import http

SEGMENT = "capture string, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, tcp_seq long, ts_us long, seq long, payload binary"
S = 1_000_000


def seg(ts, seq, at, payload, flags=24, capture="c", src="10.0.0.1"):
    return (capture, src, "10.0.0.2", 40000, 80, flags, at % 2 ** 32, int(ts * S), seq, payload)


def messages(spark, rows, **how):
    found = http.reassemble_http(spark.createDataFrame(rows, SEGMENT).repartition(3), **how)
    return sorted((r["capture"], r["connection_no"], r["started_us"], r["message_no"], bytes(r["data"])) for r in found.collect())


def test_reused_port(spark):
    get = b"GET /%d HTTP/1.1\r\n\r\n"
    rows = [seg(0, 1, 1000, get % 1), seg(3600, 2, 1000, get % 2)]                                  # silence
    rows += [seg(10, 3, 500, b"", 2), seg(10.1, 4, 501, get % 3), seg(11, 5, 900, b"", 2), seg(11.5, 6, 901, get % 4)]  # two SYNs
    rows += [seg(3601, 7, 1000 + len(get % 2), get % 5)]                                             # the same connection goes on
    assert [m[4] for m in messages(spark, rows)] == [get % 1, get % 3, get % 4, get % 2, get % 5]
    assert [m[1] for m in messages(spark, rows)] == [1, 2, 3, 4, 4]
    assert [m[1] for m in messages(spark, rows, idle_s=7200)] == [1, 2, 3, 3, 3]


def test_repeated_syn_and_captures(spark):
    get = b"GET / HTTP/1.1\r\n\r\n"
    rows = [seg(0, 1, 99, b"", 2), seg(1, 2, 99, b"", 2), seg(2, 3, 100, get)]
    rows += [(*("d",), *r[1:]) for r in rows]
    assert [(m[0], m[1], m[2], m[4]) for m in messages(spark, rows)] == [("c", 1, 0, get), ("d", 1, 0, get)]


def test_sequence_numbers_wrap_in_any_order(spark):
    rng = random.Random(3)
    body = bytes(rng.randrange(97, 122) for _ in range(6000))
    whole = b"POST /w HTTP/1.1\r\nContent-Length: 6000\r\n\r\n" + body
    start, rows = 2 ** 32 - 2500, []
    pieces = [(k, whole[k:k + 300]) for k in range(0, len(whole), 300)]
    for n, (k, piece) in enumerate(pieces):
        rows.append(seg(n * 0.01 + rng.random() * 0.05, n, start + k, piece))
        if n % 4 == 1:                                                               # repeated, and repeated in part
            rows += [seg(n * 0.01 + 0.2, 100 + n, start + k, piece), seg(n * 0.01 + 0.3, 200 + n, start + k + 10, whole[k + 10:k + 340])]
    (found,) = messages(spark, rows)
    assert found[4] == whole
    stats = http.reassembly_stats(spark.createDataFrame(rows, SEGMENT)).first()
    assert stats["retransmissions"] == 5 and stats["missing_segments"] == 0 and stats["segments"] == len(rows)


def test_chunks():
    assert dechunk(b"4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n") == (b"Wikipedia", True)
    assert dechunk(b"4\r\nWiki\r\n0\r\nA: b\r\nC: d\r\n\r\n") == (b"Wiki", True)
    assert dechunk(b"4\nWiki\n0\n\n") == (b"Wiki", True)
    assert dechunk(b"4\r\nWiki\r\n0\r\nA: b\r\n") == (b"Wiki", False)
    assert dechunk(b"28\r\n12345" + b"0\r\n\r\n") == (b"", False)                    # an unfinished chunk that ends like a body
    assert dechunk(b"") == dechunk(b"zz\r\n") == (b"", False)


def test_long_chunked_body(spark):
    lines = b"0\r\n" + b"ab\r\n" * 100_000
    body = b"%x\r\n%s\r\n0\r\n\r\n" % (len(lines), lines)
    head = b"POST /x HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n"
    rows = [(b"%s%s" % (head, body),), (head + b"28\r\n12345" + b"0\r\n\r\n",), (head + b"0\r\n" + b"t: u\r\n" * 5000 + b"\r\n",)]
    found = http.decode_http_message(spark.createDataFrame(rows, "data binary")).select("is_complete", F.length("body_final")).collect()
    assert sorted(map(tuple, found)) == [(False, 0), (True, 0), (True, len(lines))]


@pytest.mark.parametrize("count", [3, 4000])
def test_headers(spark, count):
    head = "\r\n".join([f"H{i}: {i}" for i in range(count)] + ["no colon", "h1: last", "X : a:b "])
    found = spark.createDataFrame([(head,)], "head string").select(http.headers_map(F.col("head")).alias("m")).first()["m"]
    assert found == {**{f"h{i}": str(i) for i in range(count)}, "h1": "last", "x": "a:b"}
