"""The keyed blocks against brute force, with one hot key and many slices."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import alerts, anchored, sliced
from fieldtrace.operators import ot, it, behavior, rules

HOT = 400


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows belong to one key; times collide and cross slice borders."""
    rng = random.Random(7)
    data = [("hot" if i % 3 == 0 else f"k{i % 11}", rng.randrange(0, 5000), i, f"v{rng.randrange(6)}", rng.randrange(1, 9)) for i in range(3 * HOT)]
    df = spark.createDataFrame(data, "key string, ts_us long, seq long, item string, size long")
    by = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return df, by


def collect(df, *cols):
    return {r["seq"]: tuple(r[c] for c in cols) for r in df.select("seq", *cols).collect()}


@pytest.mark.parametrize("closed", [False, True])
def test_rolling(rows, closed):
    df, by = rows
    got = collect(sliced.rolling(df, ["key"], 100, {"n": ("count", None), "s": ("sum", df["size"]), "d": ("distinct", df["item"])},
                                 closed=closed, width=150), "n", "s", "d")
    for events in by.values():
        for i, e in enumerate(events):
            live = [x for x in events[:i + 1] if (x[1] >= e[1] - 100 if closed else x[1] > e[1] - 100)]
            assert got[e[2]] == (len(live), sum(x[4] for x in live), len({x[3] for x in live}))


def test_running(rows):
    df, by = rows
    got = collect(sliced.running(df, ["key"], {"s": ("sum", df["size"]), "p": ("prev", df["ts_us"]), "m": ("past_max", df["size"])}, width=200), "s", "p", "m")
    for events in by.values():
        for i, e in enumerate(events):
            past = events[:i]
            assert got[e[2]] == (sum(x[4] for x in events[:i + 1]), past[-1][1] if past else None, max((x[4] for x in past), default=None))


def test_running_distinct(rows):
    df, by = rows
    got = collect(sliced.running_distinct(df, ["key"], "item", "d", width=200), "d")
    for events in by.values():
        for i, e in enumerate(events):
            assert got[e[2]] == (len({x[3] for x in events[:i + 1]}),)


@pytest.mark.parametrize("strict", [True, False])
def test_anchored(rows, strict):
    df, by = rows
    got = collect(anchored.anchored(df, ["key"], 37, strict=strict, width=90), "mark_us", "is_mark")
    for events in by.values():
        start = None
        for e in events:
            fresh = start is None or (e[1] - start > 37 if strict else e[1] - start >= 37)
            start = e[1] if fresh else start
            assert got[e[2]] == (start, fresh)


def test_tripped(rows):
    df, by = rows
    got = {r["seq"] for r in anchored.tripped(df, ["key"], (4, 60), width=80).collect()}
    want = set()
    for events in by.values():
        live = []
        for e in events:
            live = [t for t in live + [e[1]] if e[1] - t <= 60]
            if len(live) >= 4:
                want.add(e[2])
                live = []
    assert got == want and want


def test_median(rows):
    import statistics
    df, by = rows
    want = {k: statistics.median(x[1] for x in v) for k, v in by.items()}
    for small in (100_000, 9):
        assert {r["key"]: r["median"] for r in sliced.median_by(df, ["key"], "ts_us", small=small, cuts=3).collect()} == want


def test_median_with_far_outliers(spark, monkeypatch):
    """Far values do not crowd the others into one part: no window sorts more than ``small`` rows."""
    import random
    import statistics
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(6001)] + [1e12, -1e15, 3e18]
    df = spark.createDataFrame([("hot", v) for v in values] + [("even", float(v)) for v in (4, 1, 1, 9)], "key string, v double").repartition(4)
    staged, real = [], sliced.stage
    monkeypatch.setattr(sliced, "stage", lambda x: staged.append(real(x)) or staged[-1])
    got = {r["key"]: r["median"] for r in sliced.median_by(df, ["key"], "v", small=200, cuts=4).collect()}
    assert got == {"hot": statistics.median(values), "even": 2.5}
    assert staged[-1].groupBy("key").count().agg(F.max("count")).first()[0] <= 200
    widest = staged[1].where("key = 'hot'").groupBy("_part").count().agg(F.max("count"), F.count("_part")).first()
    assert widest[0] <= 2.5 * 6004 / 16 and widest[1] >= 15


def test_chain_alerts_meet_their_slice_only(spark):
    """A source with 1,000 chains: rows grow with the alerts, and the result is that of plain comparison."""
    from fieldtrace.operators import chains as chain_ops
    chains = [(f"C{i}", i * 4 * sliced.HOUR, i * 4 * sliced.HOUR + sliced.HOUR, "a", ["t1", f"u{i % 3}"]) for i in range(1000)]
    alerts_ = [(i * sliced.HOUR // 2 + 7, i, "X", "LOW", "a" if i % 2 else f"u{i % 3}", "t1" if i % 5 == 0 else f"u{i % 4}") for i in range(8200)]
    c = spark.createDataFrame(chains, "chain_id string, start_us long, end_us long, source_ip string, target_ips array<string>")
    a = spark.createDataFrame(alerts_, "ts_us long, seq long, anomaly_type string, severity string, src_ip string, dst_ip string")
    got = chain_ops.chain_alerts(c, a)
    want = {(cid, seq) for cid, s, e, src, aims in chains for k in range(max(0, int(2 * s // sliced.HOUR) - 1), min(8200, int(2 * e // sliced.HOUR) + 2))
            for ts, seq, _, _, x, y in [alerts_[k]] if s <= ts <= e + 60_000_000 and (x == src or y in aims)}
    assert sorted(map(tuple, got.select("chain_id", "seq").collect())) == sorted(want)
    span = F.sequence(sliced.slice_of(F.col("start_us"), sliced.HOUR), sliced.slice_of(F.col("end_us") + 60_000_000, sliced.HOUR))
    met = a.withColumn("_slice", sliced.slice_of(F.col("ts_us"), sliced.HOUR)).join(c.withColumn("_slice", F.explode(span)).withColumnRenamed("source_ip", "src_ip"), ["src_ip", "_slice"])
    assert met.count() <= 2 * len(alerts_)


def test_risk_fold(spark):
    data = [("a", i * 900_000_000, i, 0.07 if i % 2 else 0.3) for i in range(60)]
    df = spark.createDataFrame(data, "ip string, ts_us long, seq long, delta double")
    score, past = 0.0, []
    for _, t, _, d in data:
        old = sum(1 for p in past if t - p > 3_600_000_000)
        score = min(1.0, max(0.0, score - min(0.01 * old, 0.1)) + d)
        past.append(t)
    assert alerts.ip_risk_score(df).first()["risk_score"] == pytest.approx(score)


EVENT = ("ts_us long, seq long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, function_code int, function_name string, "
         "operation_type string, risk_level string, notes string, data_address int, unit_id int, raw binary, mitre array<string>, "
         "details struct<op:string,target:string,value:double,is_request:boolean,count:int,station:string,cyclic:boolean,extra:map<string,string>>")


def polling(spark, extra=()):
    """Two minutes of steady reads and an occasional small setpoint write."""
    out = []
    for i in range(240):
        t = i * 500_000
        out.append((t, i, "10.0.0.1", "10.0.0.2", 50000, 502, "MODBUS_TCP", 3, "Read", "READ", "LOW", "", 1, 1, b"", [], (None, "r1", None, True, 1, None, False, {})))
        if i % 20 == 10:
            out.append((t + 1, 1000 + i, "10.0.0.1", "10.0.0.2", 50000, 502, "MODBUS_TCP", 6, "Write", "WRITE", "MEDIUM", "", 5, 1, bytes(12) + bytes([i]), [],
                        (None, "r5", 100.0 + i % 3, True, 1, None, False, {})))
    return spark.createDataFrame(out + list(extra), EVENT)


def test_benign_traffic_is_silent(spark):
    events = polling(spark)
    found = [ot.rapid_write_sequence(events), ot.abnormal_write_rate(events), ot.ot_replay(events), ot.firmware_manipulation(events),
             ot.setpoint_manipulation(events), ot.protocol_state_violation(events), behavior.profile(events)]
    assert [f.count() for f in found] == [0] * len(found)


def test_attack_is_found(spark):
    t = 100_000_000
    bad = [(t + i * 1000, 9000 + i, "10.0.0.66", "10.0.0.2", 51000, 502, "MODBUS_TCP", 6, "Write", "WRITE", "MEDIUM", "", 5, 1, bytes(14), [],
            (None, "r5", 9000.0, True, 1, None, False, {})) for i in range(12)]
    events = polling(spark, bad)
    assert ot.rapid_write_sequence(events).count() > 0
    assert ot.setpoint_manipulation(events).count() > 0
    kinds = {r["anomaly_type"] for r in behavior.profile(events).select("anomaly_type").collect()}
    assert {"OT_NEW_MASTER", "OT_VALUE_OUT_OF_RANGE"} <= kinds
    shuffled = events.orderBy("seq", ascending=False)
    assert {r["anomaly_type"] for r in behavior.profile(shuffled).select("anomaly_type").collect()} == kinds
    rule = [{"id": "X", "name": "big write", "severity": "HIGH", "match": {"value_gt": 1000, "src_ip": ["!10.0.0.1"]}}]
    assert rules.evaluate_rules(events, rule).count() == 1
