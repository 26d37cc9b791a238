"""Small scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SECONDS = 253402300799  # last second of the year 9999


def format_bytes(size: Column) -> Column:
    """B, KB, MB, GB or TB with one decimal."""
    def text(power, unit):
        return F.format_string(f"%.1f {unit}", F.bround(size / 1024.0 ** power, 1))
    out = text(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (power + 1), text(power, unit)).otherwise(out)
    return out


def format_duration(micros: Column) -> Column:
    s = F.floor(micros / 1_000_000).cast("long")
    return (F.when(s < 60, F.format_string("%d seconds", s))
            .when(s < 3600, F.format_string("%d minutes", F.floor(s / 60)))
            .when(s < 86400, F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
            .otherwise(F.format_string("%dd %dh", F.floor(s / 86400), F.floor(s % 86400 / 3600))))


def utc_text(micros: Column) -> Column:
    """ISO time in UTC; nothing for zero, negative or out-of-range values."""
    valid = (micros > 0) & (micros <= MAX_SECONDS * 1_000_000)
    return F.when(valid, F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")


def normalize_ts(ts: Column) -> Column:
    """Seconds from a number of seconds, milliseconds or microseconds; null when it fits none."""
    millis, micros = ts / 1000.0, ts / 1_000_000.0
    fixed = (F.when(ts <= MAX_SECONDS, ts.cast("double"))
             .when((ts > 1e12) & (millis <= MAX_SECONDS), millis)
             .when((ts > 1e15) & (micros <= MAX_SECONDS), micros))
    return F.when(ts >= 0, fixed)


def ts_correction(ts: Column) -> Column:
    """How a timestamp was read: valid, milliseconds, microseconds or invalid."""
    fixed = normalize_ts(ts)
    return (F.when(fixed.isNull(), "invalid").when(ts <= MAX_SECONDS, "valid").when(ts > 1e15, "microseconds")
            .otherwise("milliseconds"))


def to_timestamp(text: Column) -> Column:
    """Epoch seconds or ISO text as a UTC timestamp, null when neither."""
    number = F.when(text.rlike(r"^\s*[+-]?[0-9]+([.][0-9]+)?\s*$"), text.cast("double"))
    return F.coalesce(F.timestamp_micros((number * 1_000_000).cast("long")), F.try_to_timestamp(text))


def period(ts: Column, interval: str) -> Column:
    """Label of the hour, day or week (Monday weeks counted from the start of the year, from 00)."""
    if interval == "hour":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if interval == "week":
        week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM-dd")


def formula_safe(text: Column) -> Column:
    """Quote text a spreadsheet would evaluate, unless it is a plain signed number."""
    starts = text.rlike(r"^[=+\-@\t\r＝＋－＠]") & (F.length(text) > 1)
    number = text.rlike(r"^[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$")
    return F.when(starts & ~number, F.concat(F.lit("'"), text)).otherwise(text)


def safe_cell(text: Column, limit: int = 32_000) -> Column:
    """Printable cell text: no control characters, a length spreadsheets accept, no formulas."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    short = F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("...[truncated]"))).otherwise(clean)
    return formula_safe(short)
