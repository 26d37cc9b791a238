

def test_all_alerts_of_an_event_belong_to_its_chain(spark):
    from fieldtrace.operators import chains
    chain = spark.createDataFrame([("C", 0, 10_000_000, "10.0.0.1", ["10.0.0.2"])],
                                  "chain_id string, start_us long, end_us long, source_ip string, target_ips array<string>")
    alerts = spark.createDataFrame([(1, 1, kind, "LOW", "10.0.0.1", "10.0.0.2") for kind in ("A", "B", "C")] + [(2, 2, "A", "LOW", "10.0.0.1", "10.0.0.9")],
                                   "ts_us long, seq long, anomaly_type string, severity string, src_ip string, dst_ip string")
    assert chains.chain_alerts(chain, alerts).count() == 4


def _random_alerts(spark, n=600):
    import random
    rng = random.Random(5)
    kinds = ["IT_PORT_SCAN", "DNS_TUNNEL", "C2_BEACON", "HTTP_WEBSHELL", "MODBUS_WRITE", "ML_ANOMALY", "PHP_EXECUTION"]
    rows = [(rng.randint(0, 4000) * 500_000, i // 2, rng.choice(kinds), rng.choice(["LOW", "HIGH"]), f"10.0.0.{rng.randint(1, 6)}", rng.choice([None, "10.0.0.1", "10.9.0.1", "10.9.0.2"]))
            for i in range(n)]
    rows += rows[:50] + [(None, 9999, "C2_BEACON", "LOW", "10.0.0.1", "10.9.0.1")]
    schema = "ts_us long, seq long, anomaly_type string, severity string, src_ip string, dst_ip string"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


def _chains(n=60):
    import random
    rng = random.Random(6)
    out = []
    for i in range(n):
        start = rng.randint(0, 3800) * 500_000
        aims = rng.sample(["10.0.0.1", "10.9.0.1", "10.9.0.2", "10.9.0.3"], rng.randint(1, 3))
        phases = [(0, "RECONNAISSANCE", start, "LOW")] * rng.randint(2, 3)
        out.append((f"C{i}", start, start + rng.choice([0, 2_000_000, 70_000_000]), f"10.0.0.{rng.randint(1, 7)}", aims, "LOW", 0.5, rng.random(), bool(i % 2), 3, phases))
    return out, ("chain_id string, start_us long, end_us long, source_ip string, target_ips array<string>, severity string, confidence double, escalation double, "
                 "has_ot_impact boolean, total_events int, phases array<struct<idx:int,phase:string,ts_us:long,severity:string>>")


def _expected(chains, alerts):
    return {c[0]: {(a[0], a[1], a[2], a[4], a[5]) for a in alerts if a[0] is not None and c[1] <= a[0] <= c[2] + 60_000_000 and (a[4] == c[3] or a[5] in c[4])}
            for c in chains}


def test_alerts_of_chains_are_not_exchanged_as_pairs(spark):
    from fieldtrace.operators import chains
    plain, alerts = _random_alerts(spark)
    rows, schema = _chains()
    found = chains.chain_alerts(spark.createDataFrame(rows, schema), alerts)
    want = {(c, *a) for c, own in _expected(rows, plain).items() for a in own}
    got = [tuple(r) for r in found.select("chain_id", "ts_us", "seq", "anomaly_type", "src_ip", "dst_ip").collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Join")]


def test_storylines_are_told_without_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from fieldtrace.operators import chains
    plain, alerts = _random_alerts(spark)
    rows, schema = _chains()
    df = spark.createDataFrame(rows, schema)
    whole = _expected(rows, plain)
    types = spark.createDataFrame([(c, sorted({a[2] for a in own})) for c, own in whole.items()], "chain_id string, types array<string>")
    kind = chains.classify_storyline(F.col("types"), F.col("has_ot_impact"), F.col("escalation"), F.size("phases"), F.col("total_events"))
    kinds = {r[0]: r[1] for r in df.join(types, "chain_id").select("chain_id", kind).collect()}
    assert len(set(kinds.values())) > 3

    def pairs(*_, **__):
        raise AssertionError("chains are paired with alerts")
    monkeypatch.setattr(chains, "chain_alerts", pairs)
    told = {r["chain_id"]: r for r in chains.storyline_table(df, alerts, key_events=7).collect()}
    assert {c: r["alerts"] for c, r in told.items()} == {c: len(own) for c, own in whole.items()}
    assert {c: r["attack_type"] for c, r in told.items()} == kinds
    for c, r in told.items():
        first = sorted(whole[c], key=lambda a: (a[0], a[1], a[2]))[:7]
        assert [(e["ts_us"], e["seq"]) for e in r["key_events"] or []] == [a[:2] for a in first]


def test_events_are_scored_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from fieldtrace.operators import ml
    staged, real = [], ml.stage
    monkeypatch.setattr(ml, "stage", lambda df: staged.append(real(df)) or staged[-1])
    rows = spark.range(400).select(
        F.col("id").alias("ts_us"), F.col("id").alias("seq"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"), F.lit("MODBUS_TCP").alias("protocol"),
        F.lit(3).alias("function_code"), F.lit("READ").alias("operation_type"), F.lit(502).alias("dst_port"), F.encode(F.lit("xy"), "UTF-8").alias("raw"),
        F.when(F.col("id") == 7, 900.0).otherwise(F.col("id") % 5).alias("threat_score"), F.when(F.col("id") == 7, 80.0).otherwise(F.col("id") % 3).alias("payload_entropy"),
        F.lit(1).alias("data_count"), F.lit(1.0).alias("time_since_last"), F.lit(0.0).alias("payload_change_rate"), F.array(F.lit("T1")).alias("mitre"))
    found = ml.ml_outlier(rows)
    assert [r["seq"] for r in found.select("seq").collect()] == [7]
    assert len(staged) == 1 and "ml_score" in staged[0].columns and staged[0].count() == 400
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()


def test_malware_summary_has_totals_families_and_the_last(spark):
    """Two families and severities; the last ten of all detections are listed, the latest first."""
    from pyspark.sql import functions as F

    from fieldtrace.operators import malware as mw
    rows = [(t, t % 2, "HIGH" if t % 3 == 0 else "CRITICAL", "STUXNET" if t % 4 == 0 else "PIPEDREAM", 0.5 + t / 100) for t in range(25)] + [(24, 1, "CRITICAL", "TRITON", 0.9)]
    found = spark.createDataFrame(rows, "ts_us long, seq long, severity string, family string, confidence double").repartition(4)
    made = mw.malware_summary(found.withColumn("evidence", F.create_map(F.lit("family"), F.col("family"), F.lit("name"), F.concat("family", F.lit("!"))))).collect()
    of = lambda part, *columns: sorted(tuple(r[c] for c in columns) for r in made if r["part"] == part)
    assert of("total", "detections") == [(26,)]
    assert of("severity", "severity", "detections") == [("CRITICAL", 17), ("HIGH", 9)]
    assert of("family", "family", "severity", "detections") == [("PIPEDREAM", "CRITICAL", 12), ("PIPEDREAM", "HIGH", 6), ("STUXNET", "CRITICAL", 4), ("STUXNET", "HIGH", 3), ("TRITON", "CRITICAL", 1)]
    last = sorted(rows, reverse=True)[:10]
    assert of("recent", "place", "ts_us", "seq", "family", "severity", "name", "confidence") == [(k + 1, t, s, f, v, f + "!", c) for k, (t, s, v, f, c) in enumerate(last)]
    none = mw.malware_summary(found.limit(0).withColumn("evidence", F.create_map(F.lit("family"), F.col("family"), F.lit("name"), F.col("family")))).collect()
    assert len(none) == 3 and {(r["part"], r["severity"], r["detections"]) for r in none} == {("total", None, 0), ("severity", "CRITICAL", 0), ("severity", "HIGH", 0)}


def test_malware_summary_counts_both_families_of_the_tables(spark, tmp_path):
    """The query next to its SQL twin over rows in which both families occur; the twin counted one and listed none."""
    import datetime

    import duckdb

    from fieldtrace.plans import all_queries
    from tests import oracle_check
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=7 * i), (0, 3)[i % 2], ("purchase", "signup", "error", "view")[i // 2 % 4], float(i), '{"k": %d}' % (i % 90)) for i in range(600)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1)
    table.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    queries, oracles = all_queries()
    made = queries["malware_summary"](spark, str(tmp_path))
    difference, n = oracle_check.compare(made, con, oracles["malware_summary"])
    assert difference == "" and {r["family"] for r in made.where("part = 'family'").collect()} == {"INDUSTROYER", "PIPEDREAM"}
