"""Captures on disk, feeds, report tables and session round trips."""

import struct

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import decode, dissect, pdus
from fieldtrace.sources import capture, feeds, store


def frame(i, payload, sport=40000, dport=502, seq=0, flags=0x18):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 256, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), i, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + tcp
    return bytes(6) + bytes([2, 0, 0, 0, 0, 1]) + b"\x08\x00" + ip


def modbus(i, fc=6):
    return struct.pack(">HHHBBHH", i, 0, 6, 1, fc, 300, i)


def pcap(frames, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1000 + i, 5, len(f), len(f)) + f
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("captures")
    frames = [frame(i, modbus(i), seq=12 * i) for i in range(200)]
    (base / "a.pcap").write_bytes(pcap(frames))
    (base / "b.pcap").write_bytes(pcap(frames, ">") + b"\x00\x01")         # truncated tail
    (base / "bad.pcap").write_bytes(b"not a capture at all, really")
    return base


def test_split_reading(spark, folder):
    """Many small splits give the same packets as one."""
    paths = [str(folder / "a.pcap"), str(folder / "b.pcap")]
    whole = capture.read_capture(spark, paths)
    split = capture.read_capture(spark, paths, split_bytes=1000)
    assert whole.count() == 400
    assert whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0
    assert capture.read_capture(spark, paths, max_packets=7).count() == 14
    times = whole.where("capture LIKE '%b.pcap'").agg(F.min("ts_us"), F.max("ts_us")).first()
    assert tuple(times) == (1000_000_005, 1199_000_005)


def test_bad_files(spark, folder):
    paths = [str(folder / "a.pcap"), str(folder / "bad.pcap")]
    assert capture.read_capture(spark, paths, mode="PERMISSIVE").count() == 200
    with pytest.raises(Exception, match="unsupported capture"):
        capture.read_capture(spark, paths).count()


def test_data_source(spark, folder, tmp_path):
    """Folders, globs, packed small files, cut long files and a written index give the same packets."""
    capture.register(spark)
    read = lambda path, **options: spark.read.format("capture").options(**options).load(path)
    whole = capture.read_capture(spark, [str(folder / "a.pcap"), str(folder / "b.pcap")])
    for found in (read(str(folder), mode="PERMISSIVE"), read(f"{folder}/[ab].pcap"), read(f"{folder}/a.pcap,{folder}/b.pcap", splitBytes=1000), capture.read_capture(spark, f"{folder}/?.pcap", split_bytes=3000)):
        assert found.exceptAll(whole).count() == 0 and whole.exceptAll(found).count() == 0
    assert read(str(folder), mode="PERMISSIVE").rdd.getNumPartitions() == 1 and read(f"{folder}/a.pcap", splitBytes=1000).rdd.getNumPartitions() > 10
    capture.index_captures(spark, f"{folder}/a.pcap", split_bytes=2000).write.parquet(str(tmp_path / "index"))
    indexed = read(f"{folder}/a.pcap", index=str(tmp_path / "index"))
    assert indexed.rdd.getNumPartitions() > 5 and indexed.exceptAll(whole).count() == 0 and indexed.count() == 200
    with pytest.raises(Exception, match="unsupported capture"):
        read(str(folder)).count()
    with pytest.raises(Exception, match="no capture"):
        read(str(folder / "none")).count()


def test_oversize_packets(spark, folder, tmp_path):
    capture.register(spark)
    frames = [frame(i, bytes(50), seq=i) + bytes(300_000 if i % 10 == 3 else 0) for i in range(30)]
    (tmp_path / "big.pcap").write_bytes(pcap(frames))
    path = str(tmp_path / "big.pcap")
    every = capture.read_capture(spark, path)
    assert every.agg(F.max(F.octet_length("data"))).first()[0] > 300_000 and tuple(capture.oversize_packets(every).first())[1:] == (30, 0)
    for limited in (capture.read_capture(spark, path, max_packet_size=1000, split_bytes=1000), spark.read.format("capture").option("maxPacketSize", 1000).load(path)):
        assert tuple(capture.oversize_packets(limited).first())[1:] == (30, 3)
        assert dissect.dissect(limited).count() == 27


def test_no_depth_is_too_deep(spark):
    """Five VLAN tags, twelve IPv6 extension headers, twelve DNS questions and twelve items before the CIP request."""
    tcp = frame(1, modbus(1))
    tagged = tcp[:12] + b"\x81\x00\x00\x05" * 5 + tcp[12:]
    udp = struct.pack(">HHHH", 1000, 53, 12, 0) + b"\xde\xad\xbe\xef"
    options = b"".join(bytes([60 if i < 11 else 17, 0]) + bytes(6) for i in range(12))
    six = struct.pack(">IHBB", 6 << 28, len(options) + len(udp), 60, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + options + udp
    rows = [("c", 0, 0, 1, tagged), ("c", 1, 0, 229, six)]
    found = {r["seq"]: (r["dst_port"], bytes(r["payload"])) for r in dissect.dissect(spark.createDataFrame(rows, capture.PACKETS)).collect()}
    assert found == {0: (502, modbus(1)), 1: (53, b"\xde\xad\xbe\xef")}
    query = struct.pack(">HHHHHH", 7, 0, 12, 0, 0, 0) + b"\x01a\x03com\x00\x00\x01\x00\x01" + b"".join(b"\x01%c\xc0\x0e\x00\x01\x00\x01" % (98 + i) for i in range(10)) + b"\xc0\x90\x00\x01\x00\x01"
    loop = struct.pack(">HHHHHH", 8, 0, 2, 0, 0, 0) + b"\x01z\xc0\x0c\x00\x01\x00\x01\xc0"
    segments = spark.createDataFrame([(0, 0, "a", "b", 999, 53, 17, query), (0, 1, "a", "b", 999, 53, 17, loop)],
                                     "ts_us long, seq long, src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int, payload binary")
    names = [r["qname"] for r in dissect.decode_dns(segments).where("seq = 0").collect()]
    assert names[:3] == ["a.com", "b.com", "c.com"] and len(names) == 12
    assert [r["qname"] for r in dissect.decode_dns(segments).where("seq = 1").collect()] == ["z.z"]
    items = b"".join(struct.pack("<HH", 0x00A1, 4) + bytes(4) for _ in range(11)) + struct.pack("<HH", 0xB2, 2) + b"\x4d\x00"
    body = struct.pack("<IHH", 0, 0, 12) + items
    enip = struct.pack("<HHII8sI", 0x6F, len(body), 1, 0, bytes(8), 0) + body
    pdu = spark.createDataFrame([("c", "a", "b", 1, 44818, "ENIP", 0, 0, 0, enip)], "capture string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, ts_us long, seq long, pdu_no int, payload binary")
    assert decode.decode_enip(pdu).first()["details"]["op"] == "WRITE"


def test_packets_to_events(spark, folder):
    packets = capture.read_capture(spark, [str(folder / "a.pcap")])
    events = decode.decode_modbus(pdus.reassemble_ot_pdus(dissect.dissect(packets)))
    row = events.agg(F.count(F.lit(1)), F.sum("details.value"), F.min("function_code"), F.max("data_address")).first()
    assert tuple(row) == (200, float(sum(range(200))), 6, 300)


def test_message_cutting():
    big = b"MSGF" + (300_000).to_bytes(4, "little") + bytes(299_992)
    run, got = pdus.Unfinished("OPC_UA"), []
    for k in range(0, len(big), 1400):
        got += run.push(big[k:k + 1400])
    assert got == [big] and run.close() == []
    assert pdus.cut(b"\x30\x80\x80", "MQTT") == ([], b"\x30\x80\x80") and pdus.cut(b"\x30\x80\x80\x80\x80", "MQTT")[1] == b""
    dnp = b"\x05\x64" + bytes([5 + 17]) + bytes(7 + 17 + 4)
    assert pdus.cut(dnp + dnp[:9], "DNP3") == ([dnp], dnp[:9])
    capped = pdus.Unfinished("OPC_UA", most=1000)
    assert capped.push(big[:900]) == [] and capped.push(big[900:2000]) == [big[:2000]]
    two = modbus(1) + modbus(2)
    assert pdus.cut(two + modbus(3)[:5], "MODBUS_TCP") == ([modbus(1), modbus(2)], modbus(3)[:5])
    assert pdus.cut(b"\xff" * 9, "MODBUS_TCP") == ([b"\xff" * 9], b"")
    assert pdus.cut(b"\x30\x02ab\x30", "MQTT") == ([b"\x30\x02ab"], b"\x30")


def test_feed(spark, tmp_path):
    (tmp_path / "ips.txt").write_text("# list\n\n1.2.3.4\n 5.6.7.8 , LOW , a, b\n")
    rows = {r["value"]: (r["severity"], r["description"]) for r in feeds.read_threat_feed(spark, str(tmp_path / "ips.txt"), "ip").collect()}
    assert rows == {"1.2.3.4": ("HIGH", "User-defined malicious ip"), "5.6.7.8": ("LOW", "a, b")}


def test_store_round_trip(spark, tmp_path):
    alerts = spark.createDataFrame([("s1", "=X", "HIGH", 5, "a", "b", "TCP", 0.5, {"k": "1"}), ("s2", "Y", "LOW", 6, "a", "c", "TCP", 0.6, {"k": "2"})],
                                   "session_id string, anomaly_type string, severity string, ts_us long, src_ip string, dst_ip string, protocol string, confidence double, evidence map<string,string>")
    sessions = spark.createDataFrame([("s1", "c1", 1), ("s2", "c2", 2)], "session_id string, capture string, started_us long")
    iocs = spark.createDataFrame([("s1", "IP", "a", "HIGH", 5, 5, 1)], "session_id string, ioc_type string, value string, severity string, first_us long, last_us long, occurrences long")
    store.append(alerts, str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).where("session_id = 's1'").count() == 1
    store.export_session(sessions.where("session_id = 's1'"), alerts, iocs, str(tmp_path / "out"))
    new, back, found = store.import_session(spark, str(tmp_path / "out"))
    assert [r["session_id"] for r in new.collect()] == ["s1-import"]
    assert [r["anomaly_type"] for r in back.collect()] == ["=X"] and found.count() == 1
    store.write_report_tables({"anomalies": alerts}, str(tmp_path / "report"))
    cells = {r["anomaly_type"] for r in spark.read.parquet(str(tmp_path / "report" / "anomalies")).collect()}
    assert cells == {"'=X", "Y"}
