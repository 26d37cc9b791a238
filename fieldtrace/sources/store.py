"""Report tables and the scan history as files partitioned by session."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.functions.scalar import safe_cell
from fieldtrace.operators.history import gone_sessions, upsert_ioc
from fieldtrace.operators.ioc import csv_rows
from fieldtrace.session import stage

_ALERTS = "array<struct<anomaly_type:string,severity:string,ts_us:bigint,src_ip:string,dst_ip:string,protocol:string,confidence:double,evidence:string>>"
_IOCS = "array<struct<ioc_type:string,value:string,severity:string,first_us:bigint,last_us:bigint,occurrences:bigint>>"
_EXPORT = f"export_version string, session struct<session_id:string,capture:string,started_us:bigint>, anomalies {_ALERTS}, iocs {_IOCS}"


def report_table(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A table made safe for spreadsheets: nested values as JSON, bytes as hex, cells cleaned."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType.typeName()
        if kind == "binary":
            c = F.lower(F.hex(c))
        elif kind in ("array", "map", "struct"):
            c = F.to_json(c)
        out.append((safe_cell(c) if kind in ("binary", "array", "map", "struct", "string") else c).alias(field.name))
    rows = df
    if limit is not None:
        rows = df.orderBy(*[n for n in ("ts_us", "seq") if n in df.columns]).limit(limit)
    return rows.select(*out)


def write_report_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", limits: dict[str, int] | None = None) -> None:
    """One folder per sheet, whole; ``limits`` keeps only the first rows of the sheets it names."""
    for name, df in tables.items():
        writer = report_table(df, (limits or {}).get(name)).write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}") if fmt == "csv" else writer.parquet(f"{folder}/{name}")


def export_iocs_csv(iocs: DataFrame, path: str) -> None:
    csv_rows(iocs).write.mode("overwrite").option("header", True).csv(path)


def export_iocs_json(iocs: DataFrame, path: str) -> None:
    """JSON lines, one folder per category."""
    iocs.withColumn("category", F.col("ioc_type")).write.mode("overwrite").partitionBy("category").json(path)


def append(df: DataFrame, folder: str, session_id: str | None = None) -> None:
    """Store rows under their session; evidence maps become JSON text."""
    rows = df if session_id is None else df.withColumn("session_id", F.lit(session_id))
    for field in df.schema.fields:
        if field.dataType.typeName() in ("map", "struct"):
            rows = rows.withColumn(field.name, F.to_json(field.name))
    rows.write.mode("append").partitionBy("session_id").parquet(folder)


def _replace_sessions(rows: DataFrame, folder: str) -> None:
    """Overwrite the partitions of the sessions in ``rows`` and no others; the rows are whole before anything is replaced."""
    stage(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(folder)


def _stored(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stored table; the session id of its folder names keeps the type it has in ``like``."""
    found = spark.read.option("recursiveFileLookup", "false").parquet(folder)
    return found.withColumn("session_id", F.col("session_id").cast(like.schema["session_id"].dataType))


def merge_iocs(spark: SparkSession, incoming: DataFrame, folder: str) -> None:
    """Merge new sightings into a stored table, one row per session, type and value; only the sessions they name are read and rewritten."""
    touched = _stored(spark, folder, incoming).join(incoming.select("session_id").distinct(), "session_id", "left_semi")
    _replace_sessions(upsert_ioc(touched.select(*incoming.columns), incoming), folder)


def session_folders(spark: SparkSession, folder: str) -> dict[str, str]:
    """Session id -> partition folder of a stored table."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if s.isDirectory()]
    return {unquote(n.split("=", 1)[1]): f"{folder.rstrip('/')}/{n}" for n in names if n.startswith("session_id=")}


def drop_sessions(spark: SparkSession, sessions: DataFrame, folder: str, **which) -> int:
    """Delete the folders of the sessions that go (see :func:`fieldtrace.operators.history.gone_sessions`); the others are not touched."""
    there, dropped = session_folders(spark, folder), 0
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for row in gone_sessions(sessions, **which).toLocalIterator():
        if row["session_id"] in there:
            path = hadoop.Path(there[row["session_id"]])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            dropped += 1
    return dropped


def session_documents(sessions: DataFrame, alerts: DataFrame, iocs: DataFrame) -> DataFrame:
    """One JSON document per exported session; sessions are selected before their rows are gathered."""
    def nested(df, like):
        names = [p.split(":")[0] for p in like[len("array<struct<"):-2].split(",")]
        cols = [F.to_json("evidence").alias("evidence") if n == "evidence" and dict(df.dtypes).get(n, "").startswith("map") else F.col(n) for n in names]
        return df.select("session_id", F.struct(*cols).alias("r")).groupBy("session_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    a = nested(alerts.join(sessions.select("session_id"), "session_id", "left_semi"), _ALERTS).withColumnRenamed("r", "anomalies")
    i = nested(iocs.join(sessions.select("session_id"), "session_id", "left_semi"), _IOCS).withColumnRenamed("r", "iocs")
    rows = sessions.join(a, "session_id", "left").join(i, "session_id", "left")
    return rows.select(F.lit("1.0").alias("export_version"), F.struct("session_id", "capture", "started_us").alias("session"), "anomalies", "iocs")


def export_session(sessions: DataFrame, alerts: DataFrame, iocs: DataFrame, path: str) -> None:
    session_documents(sessions, alerts, iocs).write.mode("overwrite").json(path)


def import_documents(documents: DataFrame, suffix: str = "-import") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, alerts and indicators of exported documents under new session ids."""
    rows = documents.withColumn("session_id", F.concat(F.col("session.session_id"), F.lit(suffix)))
    return (rows.select("session_id", "session.capture", "session.started_us"),
            rows.select("session_id", F.explode("anomalies").alias("a")).select("session_id", "a.*"),
            rows.select("session_id", F.explode("iocs").alias("i")).select("session_id", "i.*"))


def import_session(spark: SparkSession, path: str, suffix: str = "-import") -> tuple[DataFrame, DataFrame, DataFrame]:
    return import_documents(spark.read.schema(_EXPORT).json(path), suffix)
