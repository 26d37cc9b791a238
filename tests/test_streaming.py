"""Stream results equal batch results on the same rows."""

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import alerts, anchored, chains, it
from fieldtrace.plans import adapters
from fieldtrace.streaming import twins

SF = "/root/testdata/sf0.001"


def drain(spark, build, source, tmp_path, name):
    """Run a stream over parquet files of ``source`` to its end."""
    folder = str(tmp_path / name)
    source.repartitionByRange(3, "ts_us").write.parquet(folder)
    rows = twins.with_event_time(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 10).parquet(folder), "1 hour")
    query = (build(rows).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / (name + "-state"))).trigger(availableNow=True).start())
    query.awaitTermination(120)
    query.stop()
    return spark.table(name)


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def rows(spark):
    return adapters.alerts(spark, SF).select("ts_us", "seq", "anomaly_type", "src_ip", "dst_ip")


def test_suppress(spark, rows, tmp_path):
    got = drain(spark, lambda r: twins.suppress_stream(r, 200), rows, tmp_path, "suppress")
    assert pairs(got, "seq") == pairs(alerts.suppress_repeats(rows, 200), "seq")


def test_threshold_and_cooldown(spark, rows, tmp_path):
    matches = rows.select("ts_us", "seq", F.lit("R").alias("rule_id"), F.col("src_ip").alias("rule_group"))
    got = drain(spark, lambda r: twins.threshold_stream(r, 3, 60, 90), matches, tmp_path, "threshold")
    keys = ["rule_id", "rule_group"]
    want = anchored.cooled(anchored.tripped(matches, keys, (3, 60_000_000)), keys, 90_000_000)
    assert pairs(got, "seq") == pairs(want, "seq")
    assert pairs(got, "seq")


def test_exact_rate(spark, rows, tmp_path):
    from fieldtrace.operators.sliced import rolling
    got = drain(spark, lambda r: twins.rate_stream(r, ["src_ip"], 60, 3), rows, tmp_path, "rate")
    want = rolling(rows, ["src_ip"], 60_000_000, {"n": ("count", None)}).where("n > 3")
    assert pairs(got, "seq", "n") == pairs(want, "seq", "n")


def test_hourly_bytes(spark, tmp_path):
    flows = adapters.flows(spark, SF)
    # a closing row far ahead moves the watermark past every window
    end = flows.agg((F.max("ts_us") + 10 * 3600 * 10 ** 6).alias("ts_us")).select(
        F.lit("end").alias("src_ip"), F.lit("end").alias("dst_ip"), "ts_us", F.lit(1).cast("long").alias("bytes"), F.lit(1).cast("long").alias("seq"))
    got = drain(spark, lambda r: twins.hourly_bytes_stream(r, 90_000), flows.unionByName(end), tmp_path, "hourly")
    want = (flows.groupBy(F.floor(F.col("ts_us") / 3.6e9).alias("h"), "src_ip", "dst_ip").agg(F.sum("bytes").alias("hourly_bytes")).where("hourly_bytes > 90000"))
    assert pairs(got, "src_ip", "dst_ip", "hourly_bytes") == pairs(want, "src_ip", "dst_ip", "hourly_bytes")
