"""Named queries over the driver tables, each with its ANSI-SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# tables of long texts: searching them costs far more than moving them
TEXTS = ("pages", "documents")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; one that sits in fewer files than there are cores is spread first."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
