"""The common shape of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT_COLUMNS = ["ts_us", "seq", "anomaly_type", "severity", "src_ip", "dst_ip", "protocol", "description",
                 "evidence", "mitre", "confidence"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def severity_rank(col: Column) -> Column:
    """LOW=1 .. CRITICAL=4, anything else 0."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.greatest(rank, F.lit(1)).cast("int"))


def alert(df: DataFrame, kind, severity, *, evidence: dict | None = None, mitre: list[str] | Column = (),
          confidence=0.0, description=None, src="src_ip", dst="dst_ip", protocol="protocol", seq="seq") -> DataFrame:
    """Project rows that fired to the alert schema; constants and columns mix freely."""
    pairs = []
    for key, value in (evidence or {}).items():
        pairs += [F.lit(key), _column(value).cast("string")]
    facts = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    techniques = mitre if isinstance(mitre, Column) else F.array(*[F.lit(m) for m in mitre]).cast("array<string>")

    def place(value):
        return F.col(value) if isinstance(value, str) and value in df.columns else _column(value)
    return df.select(
        F.col("ts_us"), place(seq).cast("long").alias("seq"), _column(kind).alias("anomaly_type"),
        _column(severity).alias("severity"), place(src).alias("src_ip"), place(dst).alias("dst_ip"),
        place(protocol).alias("protocol"), _column(description if description is not None else kind).alias("description"),
        facts.alias("evidence"), techniques.alias("mitre"), _column(confidence).cast("double").alias("confidence"))


def union(parts: list[DataFrame]) -> DataFrame:
    """All alert streams as one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
