"""Derived columns of protocol events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: operations that change values, state, program or configuration
DANGEROUS_OPS = ["WRITE", "SETPOINT", "FIRMWARE_UPDATE", "CONFIG_WRITE", "FORCE", "MEMORY_CLEAR", "RESTART",
                 "FACTORY_RESET", "SET_IP", "SET_NAME", "CLOCK_SET"]
DANGEROUS_PREFIXES = ["CONTROL", "PLC_", "PROGRAM_"]
DANGEROUS_TYPES = ["WRITE", "CONTROL", "READ_WRITE"]
# fixed values: operations whose value is written to the process
WRITE_LIKE_OPS = ["WRITE", "SETPOINT", "CONTROL_EXECUTE", "CONTROL_DIRECT"]
# fixed values: publish/subscribe protocols
PUBLISH_PROTOCOLS = ["IEC_61850_GOOSE", "IEC_61850_SV", "PROFINET_RT"]
EPHEMERAL_PORT_START = 49152


def canonical_op() -> Column:
    """details.op, else WRITE / CONTROL / READ from the operation type, else ''."""
    op_type = F.upper(F.coalesce(F.col("operation_type"), F.lit("")))
    return (F.when(F.coalesce(F.col("details.op"), F.lit("")) != "", F.upper("details.op"))
            .when(op_type.isin("WRITE", "READ_WRITE"), "WRITE")
            .when(op_type.isin("CONTROL", "READ"), op_type).otherwise(""))


def infer_is_request() -> Column:
    """The flag when known, else the side with the higher, ephemeral port asks."""
    sport, dport = F.coalesce("src_port", F.lit(0)), F.coalesce("dst_port", F.lit(0))
    return F.coalesce(F.col("details.is_request"), (sport > dport) & (dport < EPHEMERAL_PORT_START))


def is_publication() -> Column:
    asked = F.coalesce(F.col("details.is_request"), F.lit(False))
    return ~asked & ((canonical_op() == "PUBLISH") | F.col("protocol").isin(PUBLISH_PROTOCOLS))


def is_dangerous() -> Column:
    op = canonical_op()
    prefixed = F.lit(False)
    for prefix in DANGEROUS_PREFIXES:
        prefixed = prefixed | op.startswith(prefix)
    return op.isin(DANGEROUS_OPS) | prefixed | F.upper(F.coalesce("operation_type", F.lit(""))).isin(DANGEROUS_TYPES)


def is_write_like() -> Column:
    return canonical_op().isin(WRITE_LIKE_OPS) | (F.upper(F.coalesce("operation_type", F.lit(""))) == "WRITE")


def numeric_value() -> Column:
    """details.value when it is a finite number."""
    v = F.col("details.value")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def event_target() -> Column:
    return F.when(F.coalesce(F.col("details.target"), F.lit("")) != "", F.col("details.target")).otherwise(
        F.coalesce(F.col("data_address"), F.lit(0)).cast("string"))


def enrich(events: DataFrame) -> DataFrame:
    """All derived columns at once."""
    return (events.withColumn("op", canonical_op()).withColumn("is_req", infer_is_request())
            .withColumn("is_pub", is_publication()).withColumn("dangerous", is_dangerous())
            .withColumn("write_like", is_write_like()).withColumn("num", numeric_value())
            .withColumn("target", event_target()))


def threat_score(risk: Column) -> Column:
    return (F.when(risk == "CRITICAL", 1.0).when(risk == "HIGH", 0.75).when(risk == "MEDIUM", 0.5).otherwise(0.25))


def merge_mitre(base: Column, extra: Column) -> Column:
    """Ordered union without duplicates."""
    return F.array_distinct(F.concat(base, F.coalesce(extra, F.array().cast("array<string>"))))
