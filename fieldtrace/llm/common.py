"""What the corpus operators share: registration, staging, let-bindings, row keys and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Removes a query's shuffle files when the query ends; without it they stay until the driver collects its garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def query(name: str, sql: str | None = None):
    """Register a query (spark, folder) -> DataFrame, with its SQL twin where SQL can express it."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors see.

    Only a local master, whose driver and executors are one process, may go without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile
        folder = "file://" + tempfile.mkdtemp(prefix="fieldtrace-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Tables made and read in here leave no shuffle files. For those that are read once."""
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES_SHUFFLES, before)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table that several branches read into the shared folder and read it back: lineage ends here, so a lost
    executor costs a re-read, and the planner knows the measured size. The shuffle files of the write go with its end."""
    spark = configure(df.sparkSession)
    path = new_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (and its lambdas) use it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged. Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(*columns: Column) -> Column:
    """64 bits for a row's content. Rows of equal content share it, and get equal results."""
    return F.xxhash64(*[c for x in columns for c in (x.isNull(), x)])


def join_small(big: DataFrame, small: DataFrame, on, how: str, most_rows: int = 1_000_000) -> DataFrame:
    """Join with a staged narrow table: broadcast if its counted rows are at most ``most_rows``, else a shuffled join."""
    if small.count() <= most_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)
