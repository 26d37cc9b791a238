"""Host inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: protocol and device names that decide the class of a host
OT_PROTOCOLS = ["MODBUS", "MODBUS_TCP", "S7COMM", "DNP3", "ENIP", "BACNET", "OPCUA", "OPC_UA", "IEC104", "IEC_104", "MMS"]
IT_PROTOCOLS = ["HTTP", "HTTPS", "DNS", "SMB", "RDP", "SSH"]
OT_DEVICES = ["PLC", "HMI", "RTU", "DCS", "SCADA", "IED"]


def track_assets(segments: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row per address: first known MAC, activity, bytes sent, ports, protocols.

    The two sides of a segment are two rows of one aggregation, combined on the map
    side, so a busy address costs one partial row per task.
    """
    sides = segments.select(F.explode(F.array(
        F.struct(F.col("src_ip").alias("ip"), F.col("src_mac").alias("mac"), "ts_us", "seq",
                 F.col("ip_len").cast("long").alias("sent"), F.col("src_port").alias("port")),
        F.struct(F.col("dst_ip").alias("ip"), F.lit("").alias("mac"), "ts_us", "seq", F.lit(0).cast("long").alias("sent"),
                 F.col("dst_port").alias("port")))).alias("s")).select("s.*")
    named = F.when(F.coalesce("mac", F.lit("")) != "", F.struct("ts_us", "seq", "mac"))
    hosts = sides.groupBy("ip").agg(
        F.min(named).getField("mac").alias("mac"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("packets"), F.sum("sent").alias("bytes"),
        F.array_sort(F.collect_set("port")).alias("ports"))
    if events is None:
        return hosts.withColumn("protocols", F.array().cast("array<string>")).withColumn("is_ot", F.lit(False))
    spoken = (events.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "protocol")
              .groupBy("ip").agg(F.array_sort(F.collect_set("protocol")).alias("protocols")))
    return (hosts.join(spoken, "ip", "left").withColumn("is_ot", F.col("protocols").isNotNull())
            .withColumn("protocols", F.coalesce("protocols", F.array().cast("array<string>"))))


def vendor_lookup(assets: DataFrame, vendors: DataFrame, mac: str = "mac") -> DataFrame:
    """Vendor of the longest known prefix (14, 11 or 8 characters) of ``vendors(prefix, vendor)``."""
    out = assets
    for size in (14, 11, 8):
        part = vendors.where(F.length("prefix") == size).select(
            F.upper("prefix").alias(f"_p{size}"), F.col("vendor").alias(f"_v{size}"))
        out = out.join(part, F.upper(F.substring(mac, 1, size)) == F.col(f"_p{size}"), "left")
    found = F.coalesce("_v14", "_v11", "_v8", F.lit("Unknown"))
    return out.withColumn("vendor", found).drop("_p14", "_p11", "_p8", "_v14", "_v11", "_v8")


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def classify_asset(assets: DataFrame) -> DataFrame:
    """OT, IT or Unknown by spoken protocols and, when known, the device type."""
    spoken = F.transform("protocols", lambda p: F.upper(p))
    device = F.upper(F.col("device_type")).isin(OT_DEVICES) if "device_type" in assets.columns else F.lit(False)
    return assets.withColumn("classification", F.when(F.arrays_overlap(spoken, _names(OT_PROTOCOLS)) | device, "OT")
                             .when(F.arrays_overlap("protocols", _names(IT_PROTOCOLS)), "IT").otherwise("Unknown"))


def asset_risk(assets: DataFrame, alerts: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Points for the alerts an address takes part in and for its risk score."""
    involved = (alerts.select(F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"), "severity")
                .groupBy("ip").agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
                                   F.count_if(F.col("severity") == "HIGH").alias("high")))
    rows = assets.join(involved, "ip", "left")
    rows = rows.join(scores.select("ip", "risk_score"), "ip", "left") if scores is not None else rows.withColumn(
        "risk_score", F.lit(None).cast("double"))
    points = (F.when(F.col("critical") > 0, 40).otherwise(0) + F.when(F.col("high") > 0, 20).otherwise(0)
              + F.when(F.col("alerts") > 10, 10).otherwise(0)
              + F.when(F.col("risk_score") > 0.7, 30).when(F.col("risk_score") > 0.5, 15).otherwise(0))
    return (rows.withColumn("points", points.cast("long"))
            .withColumn("risk_level", F.when(F.col("points") >= 50, "CRITICAL").when(F.col("points") >= 30, "HIGH")
                        .when(F.col("points") >= 10, "MEDIUM").otherwise("LOW")))


def filter_assets(assets: DataFrame, classification: str | None = None, risk: str | None = None, search: str = "") -> DataFrame:
    """Conjunction of optional class, level and substring search on address or MAC."""
    out = assets
    if classification:
        out = out.where(F.col("classification") == classification)
    if risk:
        out = out.where(F.col("risk_level") == risk)
    if search:
        text = search.lower()
        out = out.where(F.lower("ip").contains(text) | F.lower(F.coalesce("mac", F.lit(""))).contains(text))
    return out
