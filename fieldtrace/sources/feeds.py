"""Threat feeds from text: ``value[,severity[,description]]`` per line, ``#`` comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_feed(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    line = F.trim(F.col(column))
    rows = lines.select(line.alias("l")).where((F.col("l") != "") & ~F.col("l").startswith("#"))
    parts = F.split("l", ",", 3)
    value = F.trim(F.try_element_at(parts, F.lit(1)))
    return rows.select(
        F.lit(kind).alias("kind"), (F.lower(value) if kind in ("hash", "domain") else value).alias("value"),
        F.coalesce(F.trim(F.try_element_at(parts, F.lit(2))), F.lit("HIGH")).alias("severity"),
        F.coalesce(F.trim(F.try_element_at(parts, F.lit(3))), F.lit("User-defined malicious " + kind)).alias("description"))


def read_threat_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One feed file or folder; ``kind`` is ip, hash or domain."""
    return parse_feed(spark.read.text(path), kind)
