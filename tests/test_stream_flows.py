"""Connections, counters, expiry and late rows in streams: equal to batch, several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import alerts, anchored, chains, http, pdus
from fieldtrace.operators.sliced import rolling
from fieldtrace.plans import adapters
from fieldtrace.streaming import counters, flows, twins

SF = "/root/testdata/sf0.001"
S = 1_000_000
SEGMENT = "capture string, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, tcp_seq long, ts_us long, seq long, payload binary"


def drain(spark, build, batches, schema, tmp_path, name, delay="1 second", **trigger):
    """One micro-batch for each list of rows, the query started anew for each."""
    folder = str(tmp_path / name)
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        rows = twins.with_event_time(spark.readStream.schema(schema).parquet(folder), delay)
        query = (build(rows).writeStream.queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / (name + "-state")))
                 .foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / (name + "-out")))).trigger(**trigger or {"availableNow": True}).start())
        assert query.awaitTermination(100)
        yield query


def result(spark, tmp_path, name):
    return spark.read.parquet(str(tmp_path / (name + "-out")))


def seg(ts, seq, at, payload, flags=24, capture="c", src="10.0.0.1", port=80):
    return (capture, src, "10.0.0.2", 40000, port, flags, at % 2 ** 32, int((ts + 1000) * S), seq, payload)  # no time is as early as the first watermark


def split(rows, n):
    rows = sorted(rows, key=lambda r: (r[7], r[8]))
    return [rows[k * len(rows) // n:(k + 1) * len(rows) // n] for k in range(n)]


#: A row far ahead of all others: the watermark passes every timer.
def closing(port):
    return [[seg(10 ** 6, 10 ** 6, 0, b"", 2, "end", "end", port)], [seg(2 * 10 ** 6, 10 ** 6 + 1, 0, b"", 2, "end", "end", port)]]


def modbus(i):
    return i.to_bytes(2, "big") + b"\0\0\0\6\1\6\0\1" + i.to_bytes(2, "big")


def test_industrial_messages(spark, tmp_path):
    rng, rows, n = random.Random(4), [], 0
    for capture in "cd":
        for host in range(3):
            stream = b"".join(modbus(i) for i in range(30)) + modbus(99)[:7]          # the last message stays unfinished
            at, t, place = 0, host * 5.0, 2 ** 32 - 100
            while at < len(stream):
                size = rng.randint(1, 25)
                rows.append(seg(t, n, place + at, stream[at:at + size], 24, capture, f"10.0.1.{host}", 502))
                if rng.random() < 0.2:
                    rows.append(seg(t + 0.01, n + 1, place + at, stream[at:at + size], 24, capture, f"10.0.1.{host}", 502))
                at, t, n = at + size, t + 1, n + 2
            rows.append(seg(t + 400 + host, n, place + at, modbus(7), 24, capture, f"10.0.1.{host}", 502))   # after a long silence
            rows.append(seg(t + 410 + host, n + 1, 5000, modbus(8)[:6], 25, capture, f"10.0.1.{host}", 502))  # a gap, then FIN
            n += 2
    schema = SEGMENT
    marked = lambda df: df.withColumn("protocol", F.lit("MODBUS_TCP"))
    for _ in drain(spark, lambda r: flows.pdu_stream(marked(r), 300), [*split(rows, 3), *closing(502)], schema, tmp_path, "pdu"):
        pass
    columns = ["capture", "src_ip", "ts_us", "seq", "pdu_no", "payload"]
    want = pdus.reassemble_ot_pdus(spark.createDataFrame(rows, schema).withColumn("ip_proto", F.lit(6)), idle_s=300).select(*columns)
    got = result(spark, tmp_path, "pdu").where("capture <> 'end'").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where(F.octet_length("payload") == 7).count() == 6                     # the unfinished ones


def test_http_messages(spark, tmp_path):
    rng, rows, n = random.Random(5), [], 0
    for capture in "cd":
        for host in range(3):
            start = 2 ** 32 - 700
            posts = [b"POST /%d HTTP/1.1\r\nContent-Length: %d\r\n\r\n%s" % (k, 50 * k, b"x" * 50 * k) for k in range(8)]
            rows.append(seg(0, n, start - 1, b"", 2, capture, f"10.0.2.{host}"))
            t, place, parts = 1.0, start, []
            for post in posts:
                for k in range(0, len(post), 60):
                    parts.append((t, place + k, post[k:k + 60]))
                    t += 0.5
                place += len(post)
            for i in range(0, len(parts) - 2, 5):                                      # some arrive two places late
                parts[i + 1], parts[i + 2] = (parts[i + 1][0], *parts[i + 2][1:]), (parts[i + 2][0], *parts[i + 1][1:])
            lost = host == 2 and len(parts) // 2
            for i, (ts, at, piece) in enumerate(parts):
                n += 1
                if not lost or i != lost:
                    rows.append(seg(ts, n, at, piece, 24, capture, f"10.0.2.{host}"))
                if rng.random() < 0.2:
                    rows.append(seg(ts + 0.1, n + 100_000, at, piece, 24, capture, f"10.0.2.{host}") if i != lost else rows[-1])
            n += 1
            rows.append(seg(t + 500, n, start, b"GET /again HTTP/1.1\r\n\r\n", 24, capture, f"10.0.2.{host}"))   # the port used anew
    rows = list(dict.fromkeys(rows))
    for _ in drain(spark, lambda r: flows.http_message_stream(r, 300), [*split(rows, 3), *closing(80)], SEGMENT, tmp_path, "http"):
        pass
    columns = ["capture", "src_ip", "started_us", "message_no", "ts_us", "last_us", "chunks", "data"]
    want = http.reassemble_http(spark.createDataFrame(rows, SEGMENT), 300).select(*columns)
    got = result(spark, tmp_path, "http").where("capture <> 'end'")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.collect()))
    decoded = http.decode_http_message(got)
    assert decoded.where("is_complete").count() >= 2 * 2 * 9 and got.count() == 2 * 3 * 9


@pytest.fixture(scope="module")
def alert_rows(spark):
    rows = adapters.alerts(spark, SF).select("ts_us", "seq", "anomaly_type", "src_ip", "dst_ip")
    return [tuple(r) for r in rows.collect()], rows.schema, rows


def parts(rows, n):
    rows = sorted(rows)
    return [rows[k * len(rows) // n:(k + 1) * len(rows) // n] for k in range(n)]


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_slot_rate(spark, alert_rows, tmp_path):
    rows, schema, batch = alert_rows
    for _ in drain(spark, lambda r: counters.slot_rate_stream(r, ["src_ip"], 60, 2, slots=12), parts(rows, 2), schema, tmp_path, "slots"):
        pass
    slot = 5 * S
    placed = batch.withColumns({"_t": F.col("ts_us") - F.col("ts_us") % slot, "_order": F.struct("ts_us", "seq")})
    want = rolling(placed, ["src_ip"], 60 * S, {"n": ("count", None)}, ts="_t", seq="_order").where("n > 2")
    got = result(spark, tmp_path, "slots")
    assert pairs(got, "seq", "n") == pairs(want, "seq", "n") and got.count() > 5


def test_slot_state_is_bounded(spark, tmp_path):
    schema = "ts_us long, seq long, src_ip string"
    batches = [[(k * 4000 * S // 1000 + i, k * 4000 + i, "hot") for i in range(4000)] for k in range(3)]
    rows_in_state = []
    for query in drain(spark, lambda r: counters.slot_rate_stream(r, ["src_ip"], 60, 10 ** 6, slots=60), batches, schema, tmp_path, "hot"):
        rows_in_state.append(max(int(s["customMetrics"].get("numMapStateVars", 1)) * int(s["numRowsTotal"]) for p in query.recentProgress for s in p["stateOperators"]))
    assert max(rows_in_state) <= 60 + 5


def test_expiring_and_coarse_suppression(spark, alert_rows, tmp_path):
    rows, schema, batch = alert_rows
    # state that expires by the clock wants ever more batches, so each run is told to take one
    for _ in drain(spark, lambda r: counters.expiring_suppress_stream(r, 200), parts(rows, 2), schema, tmp_path, "ttl", once=True):
        pass
    assert pairs(result(spark, tmp_path, "ttl"), "seq") == pairs(alerts.suppress_repeats(batch, 200), "seq")
    for _ in drain(spark, counters.coarse_suppress_stream, [[(0, 1, "A", "x", "y"), (1, 2, "A", "x", "y"), (2, 3, "B", "x", "y")], [(5 * S, 4, "A", "x", "y")], [(100 * S, 5, "C", "x", "y")], [(101 * S, 6, "A", "x", "y")]],
                   schema, tmp_path, "coarse", "30 seconds"):
        pass
    assert [r[0] for r in pairs(result(spark, tmp_path, "coarse").select(F.when(F.col("seq") < 3, 1).otherwise(F.col("seq")).alias("seq")), "seq")] == [1, 3, 5, 6]


def test_late_rows_are_counted(spark, tmp_path):
    schema = "ts_us long, seq long, src_ip string"
    batches = [[(100 * S, 1, "a"), (200 * S, 2, "b")], [(300 * S, 3, "a")], [(10 * S, 4, "a"), (11 * S, 5, "b"), (12 * S, 6, "c"), (310 * S, 7, "a")]]
    listener = counters.LateRows()
    spark.streams.addListener(listener)
    late = [counters.late_rows(q) for q in drain(spark, lambda r: counters.slot_rate_stream(r, ["src_ip"], 60, 0), batches, schema, tmp_path, "late")]
    spark.streams.removeListener(listener)
    assert late == [0, 0, 3]
    assert pairs(result(spark, tmp_path, "late"), "seq") == [(1,), (2,), (3,), (7,)]
    assert listener.counts["late"] in (0, 3)     # the listener is told later than the query ends


def test_scan_windows(spark, alert_rows, tmp_path):
    rows, schema, _ = alert_rows
    for _ in drain(spark, lambda r: twins.scan_windows_stream(r, 60), parts(rows, 2), schema, tmp_path, "scan", "1 hour"):
        pass
    mark, want = {}, []
    for ts, seq, _, src, _ in sorted(rows):
        mark[src] = mark[src] if src in mark and ts - mark[src] <= 60 * S else ts
        want.append((seq, mark[src]))
    assert pairs(result(spark, tmp_path, "scan"), "seq", "mark_us") == sorted(want)


def test_chain_sessions(spark, alert_rows, tmp_path):
    rows, schema, batch = alert_rows
    end = [[(10 ** 12, 10 ** 9, "IT_PORT_SCAN_FAST", "end", "end")], [(2 * 10 ** 12, 10 ** 9 + 1, "IT_PORT_SCAN_FAST", "end", "end")]]
    for _ in drain(spark, lambda r: twins.chain_stream(r, 100), [*parts(rows, 2), *end], schema, tmp_path, "chains", "1 second"):
        pass
    phased = batch.withColumn("phase", chains.detect_phase(F.col("anomaly_type"))).where("phase IS NOT NULL").select("src_ip", "ts_us", "phase").collect()
    want, runs = [], {}
    for src, ts, phase in sorted(map(tuple, phased)):
        last = runs.setdefault(src, [[]])[-1]
        if last and ts - last[-1][0] > 100 * S:
            runs[src].append(last := [])
        last.append((ts, phase))
    for src, lists in runs.items():
        want += [(src, len(x), x[0][0], x[-1][0]) for x in lists if len(x) >= 2 and len({p for _, p in x}) >= 2]
    assert pairs(result(spark, tmp_path, "chains"), "src_ip", "total_events", "start_us", "end_us") == sorted(want) and want
