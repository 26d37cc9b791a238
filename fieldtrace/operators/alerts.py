"""Shaping of raw alerts: merging, cooldowns, learned baselines, whitelists, risk per host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.net import glob_match, port_match
from fieldtrace.operators.anchored import anchored, batched, cooled, groups
from fieldtrace.operators.sliced import HOUR, first_rows, numbered, rolling, running, seconds, slice_of
from fieldtrace.session import width as parallel


def dedup_alerts(alerts: DataFrame, window_s: float = 60.0, keys=("anomaly_type", "src_ip", "dst_ip")) -> DataFrame:
    """Merge repeats of an alert into the first of each window.

    Repeats raise the confidence by 0.02 each (at most 1) and a MEDIUM alert that
    repeats more than ten times becomes HIGH.
    """
    keys = list(keys)
    rows = anchored(alerts, keys, seconds(window_s), strict=False)
    rest = [c for c in alerts.columns if c not in keys]
    first = F.struct("ts_us", "seq", *[F.col(c).alias(f"_{c}") for c in rest])
    order = F.struct("ts_us", "seq")
    merged = rows.groupBy(*keys, "mark_us").agg(
        F.min_by(first, order).alias("f"), F.count(F.lit(1)).alias("occurrences"), F.max("ts_us").alias("last_us"))
    out = merged.select(*keys, *[F.col(f"f._{c}").alias(c) for c in rest], "occurrences", "last_us")
    return (out.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + 0.02 * (F.col("occurrences") - 1)))
            .withColumn("severity", F.when((F.col("occurrences") > 10) & (F.col("severity") == "MEDIUM"), "HIGH")
                        .otherwise(F.col("severity"))))


def suppress_repeats(alerts: DataFrame, window_s: float = 60.0, keys=("anomaly_type", "src_ip", "dst_ip")) -> DataFrame:
    """Drop an alert less than a window after the last one let through."""
    return cooled(alerts, list(keys), seconds(window_s))


# --------------------------------------------------------------------------- baselines

PAIR = ["src_ip", "dst_ip", "protocol"]


def _clock(ts: str = "ts_us"):
    at = F.timestamp_micros(F.col(ts))
    return F.hour(at), F.weekday(at)


def learn_baseline(events: DataFrame, period_s: float = 3600.0, max_pairs: int | None = None) -> DataFrame:
    """Learned normal of each conversation: rhythm, functions, operations, active hours and days.

    All sets are bounded (functions, operations, 24 hours, 7 days). ``max_pairs``
    keeps the conversations first seen, as an explicit limit.
    """
    hour, day = _clock()
    rows = running(events.select("ts_us", "seq", *PAIR, "function_code", "operation_type"), PAIR,
                   {"_prev": ("prev", F.col("ts_us"))})
    gap = (F.col("ts_us") - F.col("_prev")) / 1e6
    learned = rows.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(gap).alias("avg_interval"), F.stddev_pop(gap).alias("std_interval"),
        F.min(gap).alias("min_interval"), F.max(gap).alias("max_interval"),
        F.array_sort(F.collect_set("function_code")).alias("function_codes"),
        F.array_sort(F.collect_set("operation_type")).alias("operations"),
        F.array_sort(F.collect_set(hour)).alias("active_hours"), F.array_sort(F.collect_set(day)).alias("active_days"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.min(F.struct("ts_us", "seq")).alias("_first"))
    learned = learned.withColumn("is_stable", F.col("last_us") - F.col("first_us") >= seconds(period_s))
    if max_pairs is not None:
        learned = learned.orderBy("_first").limit(max_pairs)
    return learned.drop("_first")


def baseline_stats(baselines: DataFrame, rules: int = 0, active: int = 0) -> DataFrame:
    return baselines.agg(
        F.count(F.lit(1)).alias("total_baselines"), F.count_if("is_stable").alias("stable_baselines"),
        F.count_if(~F.col("is_stable")).alias("learning_baselines"), F.sum("samples").alias("events_learned"),
        F.lit(rules).cast("long").alias("whitelist_rules"), F.lit(active).cast("long").alias("active_rules"))


@dataclass(frozen=True)
class WhitelistRule:
    """Known-good traffic. Empty fields match everything; patterns use ``*``; ports may be ranges."""
    src_ip: str = ""
    dst_ip: str = ""
    protocol: str = ""
    src_port: str = ""
    dst_port: str = ""
    function_codes: tuple[int, ...] = ()
    hours: tuple[int, ...] = ()
    days: tuple[int, ...] = ()
    expires_us: int = 0
    reduction: float = 0.3
    enabled: bool = True

    def predicate(self) -> Column:
        hour, day = _clock()
        tests = [F.lit(self.enabled)]
        if self.expires_us > 0:
            tests.append(F.col("ts_us") <= self.expires_us)
        for pattern, column in ((self.src_ip, "src_ip"), (self.dst_ip, "dst_ip")):
            if pattern:
                tests.append(glob_match(F.col(column), pattern))
        if self.protocol and self.protocol != "*":
            tests.append(F.col("protocol") == self.protocol)
        for pattern, column in ((self.src_port, "src_port"), (self.dst_port, "dst_port")):
            if pattern:
                tests.append(F.coalesce(port_match(F.col(column), pattern), F.lit(False)))
        if self.function_codes:
            tests.append(F.coalesce(F.col("function_code").isin(list(self.function_codes)), F.lit(True)))
        if self.hours:
            tests.append(hour.isin(list(self.hours)))
        if self.days:
            tests.append(day.isin(list(self.days)))
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def adjust_confidence(alerts: DataFrame, events: DataFrame, rules: list[WhitelistRule] = (),
                      period_s: float = 3600.0) -> DataFrame:
    """Lower the confidence of whitelisted and habitual alerts and drop what becomes too weak.

    Rules are columns, not a table, so no pairing of alerts with rules takes place.
    An event is learned before it is judged, so its own function, operation and time
    are always known; what varies is whether the conversation was stable by then.
    """
    reduction, matched = F.lit(0.0), F.lit(False)
    for rule in rules:
        hit = F.coalesce(rule.predicate(), F.lit(False))
        reduction = reduction + F.when(hit, F.lit(float(rule.reduction))).otherwise(F.lit(0.0))
        matched = matched | hit
    first = events.groupBy(*PAIR).agg(F.min("ts_us").alias("_first_us"))
    rows = alerts.withColumn("_c", F.greatest(F.lit(0.0), F.col("confidence") - reduction)).withColumn("_hit", matched)
    rows = rows.where(~(F.col("_hit") & (F.col("_c") < 0.2))).join(first, PAIR, "left")
    stable = F.coalesce(F.col("ts_us") - F.col("_first_us") >= seconds(period_s), F.lit(False))
    habit = (F.when(F.coalesce(F.col("function_code"), F.lit(0)) != 0, 0.8).otherwise(1.0)
             * F.when(F.coalesce(F.col("operation_type"), F.lit("")) != "", 0.8).otherwise(1.0) * 0.9)
    rows = rows.withColumn("_stable", stable).withColumn(
        "_c", F.when(F.col("_stable"), F.col("_c") * habit).otherwise(F.col("_c")))
    return (rows.where(~(F.col("_stable") & (F.col("_c") < 0.15))).withColumn("confidence", F.col("_c"))
            .drop("_c", "_hit", "_first_us", "_stable"))


# --------------------------------------------------------------------------- host risk

_STEP = pa.schema([("ip", pa.string()), ("_slice", pa.int64()), ("shift", pa.float64()), ("lo", pa.float64()),
                   ("hi", pa.float64())])


def _compose(slots: list[str]):
    """Compose s -> clamp(s + shift, lo, hi) over the rows of each group; clamps are closed under composition."""
    def rows(batches):
        for key, c in groups(batches, slots):
            shift, lo, hi = 0.0, 0.0, float("inf")
            for d, a, b in zip(c["shift"], c["lo"], c["hi"]):
                shift, lo, hi = shift + d, min(max(lo + d, a), b), min(max(hi + d, a), b)
            yield (key[0], int(key[1]) if len(key) > 1 else 0, shift, lo, hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), _STEP)
    return run


def ip_risk_score(violations: DataFrame, whitelist: list[str] = (), legitimate: DataFrame | None = None,
                  decay_s: float = 3600.0, step: float = 0.01, max_decay: float = 0.1) -> DataFrame:
    """Risk per host from ``violations(ip, ts_us, seq, delta)``.

    Before each violation the score decays by ``step`` per violation older than
    ``decay_s``, then the delta is added and the score is capped at 1. Each update
    is a clamp, and clamps compose, so slices of a host are reduced independently
    and then combined in order. ``legitimate(ip, hits)`` halves the deltas of hosts
    with more than 100 harmless hits.
    """
    rows = violations.where(~F.col("ip").isin(list(whitelist))) if whitelist else violations
    rows = rows.select("ip", "ts_us", "seq", "delta")
    if legitimate is not None:
        rows = (rows.join(legitimate.select("ip", "hits"), "ip", "left")
                .withColumn("delta", F.when(F.col("hits") > 100, F.col("delta") * 0.5).otherwise(F.col("delta"))).drop("hits"))
    recent = rolling(rows, ["ip"], seconds(decay_s), {"recent": ("count", None)}, closed=True)
    ranked = numbered(recent, ["ip"])
    old = F.col("rn") - F.col("recent")
    steps = ranked.select(
        "ip", slice_of(F.col("ts_us"), HOUR).alias("_slice"), "ts_us", "seq",
        (F.col("delta") - F.least(old * step, F.lit(max_decay))).alias("shift"),
        F.col("delta").alias("lo"), F.lit(1.0).alias("hi"))
    ddl = "ip string, _slice long, shift double, lo double, hi double"
    local = (steps.repartition(parallel(steps), "ip", "_slice").sortWithinPartitions("ip", "_slice", "ts_us", "seq")
             .mapInArrow(_compose(["ip", "_slice"]), ddl))
    total = (local.repartition("ip").sortWithinPartitions("ip", "_slice").mapInArrow(_compose(["ip"]), ddl))
    score = F.least(F.greatest(F.col("shift"), F.col("lo")), F.col("hi"))
    return total.select("ip", score.alias("risk_score"))


def ip_risk_profile(scores: DataFrame, violations: DataFrame, touched: DataFrame, last: int = 10) -> DataFrame:
    """Score, last violations and level of each host; ``touched(ip)`` lists hosts that reached OT devices."""
    counts = violations.groupBy("ip").agg(F.count(F.lit(1)).alias("violation_count"))
    recent = (first_rows(violations, ["ip"], [F.desc("ts_us"), F.desc("seq")], k=last)
              .groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("ts_us", "seq", "reason"))).alias("_v")))
    rows = (scores.join(counts, "ip", "left").join(recent, "ip", "left")
            .join(touched.select("ip").distinct().withColumn("touched_ot", F.lit(True)), "ip", "left")
            .withColumn("touched_ot", F.coalesce("touched_ot", F.lit(False))))
    s, ot = F.col("risk_score"), F.col("touched_ot")
    return rows.select("ip", "risk_score", "touched_ot", "violation_count",
                       F.transform("_v", lambda v: v["reason"]).alias("violations"),
                       F.when((s >= 0.7) & ot, "CRITICAL").when((s >= 0.5) | ((s >= 0.3) & ot), "HIGH")
                       .when(s >= 0.2, "MEDIUM").when(s > 0, "LOW").otherwise("NONE").alias("threat_level"))
