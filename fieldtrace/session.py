"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REQUIRED = {
    # hours, weekdays and chain ids are defined in UTC
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: partition coalescing, skewed joins, broadcast by measured size
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # decoders treat malformed bytes as null rather than as an error
    "spark.sql.ansi.enabled": "false",
    # a Python worker holds a batch several times over (as given, as objects, as result), and each core has a worker
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume to an existing session."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fieldtrace") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("FIELDTRACE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several branches read.

    Writes to the reliable checkpoint folder, so a lost executor costs a re-read
    and not a recomputation. The cluster names the folder in
    ``spark.checkpoint.dir``; a temporary one is used only where none is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or _own_folder(spark))
    return df.checkpoint(eager=True)


def _own_folder(spark: SparkSession) -> str:
    """A temporary folder, where driver and executors are one process."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="fieldtrace-checkpoint-")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share, deleted when the driver's JVM ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = _own_folder(spark)
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def width(df: DataFrame) -> int:
    """Partitions for a stage that runs Python: a fixed number, because adaptive coalescing judges
    a partition by its bytes and would put compute-heavy work on few cores."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
