"""Learn what is normal at the start of a capture and report what deviates later.

Detection events are reduced to one row per (source, destination, protocol,
function) before any join, so the joins against what was learned are between
small tables whatever one conversation contributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.operators.events import enrich, merge_mitre
from fieldtrace.operators.shaping import alert, union
from fieldtrace.operators.sliced import HOUR, first_rows, median_by, rolling, running, seconds
from fieldtrace.session import stage

FLOW = ["src_ip", "dst_ip", "protocol"]
FUNC = [*FLOW, "function_code"]
POLL_MIN_REQUESTS, POLL_MAX_CV = 10, 0.3
POLL_GAP_FACTOR, POLL_GAP_EXTRA_US = 5.0, seconds(5)
STORM_PERIODS, STORM_FACTOR = 10, 5.0
VALUE_MIN_SAMPLES, VALUE_MAD_FACTOR = 5, 6.0


@dataclass(frozen=True)
class Split:
    """Learning window: everything up to ``learn_end_us``."""
    start_us: int
    end_us: int
    learn_end_us: int


def learning_split(events: DataFrame, fraction: float = 0.3, min_seconds: float = 60.0,
                   min_events: int = 50) -> Split | None:
    """Bounds of the learning window, or None when the capture is too short to judge.

    Only aggregates reach the driver: extent, count and the time of event number
    ``min_events`` (a distributed top-k).
    """
    if not 0.0 <= fraction < 1.0 or min_seconds < 0 or min_events < 1:
        raise ValueError("fraction must be in [0, 1), min_seconds >= 0 and min_events >= 1")
    extent = events.agg(F.min("ts_us"), F.max("ts_us"), F.count(F.lit(1))).first()
    if extent[2] < 2 * min_events:
        return None
    enough = events.select("ts_us").orderBy("ts_us").limit(min_events).agg(F.max("ts_us")).first()[0]
    learn_end = max(int(extent[0] + fraction * (extent[1] - extent[0])), extent[0] + seconds(min_seconds), enough)
    return None if learn_end >= extent[1] else Split(extent[0], extent[1], learn_end)


def split_events(events: DataFrame, split: Split) -> tuple[DataFrame, DataFrame]:
    rows = enrich(events)
    return rows.where(F.col("ts_us") <= split.learn_end_us), rows.where(F.col("ts_us") > split.learn_end_us)


@dataclass(frozen=True)
class Learned:
    """What profiling shares between detectors: small tables, each computed once."""
    talkers: DataFrame
    endpoints: DataFrame
    functions: DataFrame
    observed: DataFrame
    polling: DataFrame


def prepare(learn: DataFrame, detect: DataFrame, **learning) -> Learned:
    return Learned(*[stage(t) for t in (talkers(learn), endpoints(learn), functions(learn), _observed(detect), learn_polling(learn, **learning))])


def _talks(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("is_req") | F.col("is_pub"))


def endpoints(learn: DataFrame) -> DataFrame:
    """Every address seen with a protocol, on either side."""
    return (learn.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "protocol").distinct())


def talkers(learn: DataFrame) -> DataFrame:
    return _talks(learn).select(*FLOW).distinct()


def functions(learn: DataFrame) -> DataFrame:
    return _talks(learn).select(*FUNC).distinct()


def _observed(detect: DataFrame) -> DataFrame:
    """Detection traffic per conversation and function."""
    rows = _talks(detect).withColumn("pub", ~F.col("is_req") & F.col("is_pub")).withColumn(
        "cyclic", F.coalesce(F.col("details.cyclic"), F.lit(False)))
    first = F.struct("ts_us", "seq", "pub", "src_ip", "dst_ip", "function_code", "function_name", "mitre")
    return rows.groupBy(*FUNC, "pub", "cyclic").agg(
        F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.max("dangerous").alias("dangerous"),
        F.max(F.upper("risk_level").isin("HIGH", "CRITICAL")).alias("high_risk"), F.collect_set("op").alias("ops"))


def _summary():
    return [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("dangerous").alias("dangerous"),
            F.max("high_risk").alias("high_risk"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ops")))).alias("ops"),
            F.array_sort(F.collect_set("function_code")).alias("fcs")]


def _fire(rows: DataFrame, kind, severity, confidence, mitre, evidence) -> DataFrame:
    flat = rows.withColumn("ts_us", F.col("first.ts_us")).withColumn("seq", F.col("first.seq"))
    return alert(flat, kind, severity, confidence=confidence, mitre=mitre, evidence=evidence)


def new_master(learn: DataFrame, detect: DataFrame, ready: Learned | None = None) -> DataFrame:
    """A host that starts talking to a device others already used."""
    known = ready.endpoints if ready else endpoints(learn)
    talking = ready.talkers if ready else talkers(learn)
    rows = ((ready.observed if ready else _observed(detect)).join(talking, FLOW, "left_anti")
            .join(known.withColumnRenamed("ip", "dst_ip"), ["dst_ip", "protocol"], "left_semi")
            .groupBy(*FLOW).agg(*_summary()))
    # the first ten masters by address; pruned per map task, never collected whole
    # a sample of the peers, and how many there are
    peers = (first_rows(talking, ["dst_ip", "protocol"], ["src_ip"], k=10)
             .groupBy("dst_ip", "protocol").agg(F.array_sort(F.collect_list("src_ip")).alias("peers"))
             .join(talking.groupBy("dst_ip", "protocol").agg(F.count_distinct("src_ip").alias("peer_count")), ["dst_ip", "protocol"]))
    rows = rows.join(peers, ["dst_ip", "protocol"], "left")
    return _fire(rows, "OT_NEW_MASTER", F.when(F.col("dangerous"), "HIGH").otherwise("MEDIUM"),
                 F.when(F.col("dangerous"), 0.8).otherwise(0.65), ["T0848", "T0855"],
                 {"event_count": F.col("n"), "operations": F.array_join("ops", ","),
                  "function_codes": F.array_join("fcs", ","), "known_peers": F.array_join("peers", ","), "known_peer_count": F.coalesce("peer_count", F.lit(0)),
                  "role": F.when(F.col("first.pub"), "publisher").otherwise("master")})


def new_device(learn: DataFrame, detect: DataFrame, ready: Learned | None = None) -> DataFrame:
    """A server or publisher no one used while learning."""
    known = ready.endpoints if ready else endpoints(learn)
    rows = ((ready.observed if ready else _observed(detect)).join(ready.talkers if ready else talkers(learn), FLOW, "left_anti")
            .join(known.withColumnRenamed("ip", "dst_ip"), ["dst_ip", "protocol"], "left_anti")
            .withColumn("ip", F.when(F.col("pub"), F.col("src_ip")).otherwise(F.col("dst_ip")))
            .withColumn("peer", F.when(F.col("pub"), F.col("dst_ip")).otherwise(F.col("src_ip")))
            .join(known, ["ip", "protocol"], "left_anti"))
    met = rows.groupBy("ip", "protocol", "peer").agg(F.min("first").alias("met"))
    peers = (first_rows(met, ["ip", "protocol"], ["met.ts_us", "met.seq"], k=16)
             .groupBy("ip", "protocol").agg(F.array_sort(F.collect_list("peer")).alias("peers"))
             .join(met.groupBy("ip", "protocol").agg(F.count(F.lit(1)).alias("peer_count")), ["ip", "protocol"]))
    rows = rows.groupBy("ip", "protocol").agg(*_summary()).join(peers, ["ip", "protocol"])
    rows = rows.withColumn("src_ip", F.col("first.src_ip")).withColumn("dst_ip", F.col("first.dst_ip"))
    return _fire(rows, "OT_NEW_DEVICE", "LOW", 0.5, [],
                 {"device": F.col("ip"), "event_count": F.col("n"), "peers": F.array_join("peers", ","), "peer_count": F.col("peer_count"),
                  "role": F.when(F.col("first.pub"), "publisher").otherwise("server")})


def new_function(learn: DataFrame, detect: DataFrame, ready: Learned | None = None) -> DataFrame:
    """A known talker using a function it never used while learning."""
    rows = ((ready.observed if ready else _observed(detect)).where(~(F.col("pub") & F.col("cyclic")))
            .join(ready.functions if ready else functions(learn), FUNC, "left_anti")
            .join(ready.talkers if ready else talkers(learn), FLOW, "left_semi")
            .groupBy(*FUNC).agg(*_summary()))
    serious = F.col("dangerous") | F.col("high_risk")
    return _fire(rows, "OT_NEW_FUNCTION", F.when(serious, "HIGH").otherwise("MEDIUM"),
                 F.when(serious, 0.75).otherwise(0.6), merge_mitre(F.array(F.lit("T0855")), F.col("first.mitre")),
                 {"function_code": F.col("function_code"), "function_name": F.col("first.function_name"),
                  "event_count": F.col("n")})


# --------------------------------------------------------------------------- polling

def learn_polling(learn: DataFrame, min_requests: int = POLL_MIN_REQUESTS, max_cv: float = POLL_MAX_CV) -> DataFrame:
    """Requests repeated at steady intervals: period, variation, samples and last time."""
    asked = learn.where("is_req").select("ts_us", "seq", *FUNC)
    gaps = running(asked, FUNC, {"_prev": ("prev", F.col("ts_us"))}).withColumn("gap", F.col("ts_us") - F.col("_prev"))
    stats = gaps.groupBy(*FUNC).agg(F.count(F.lit(1)).alias("samples"), F.avg("gap").alias("mean"),
                                    F.stddev_pop("gap").alias("std"), F.max("ts_us").alias("last_us"))
    steady = stats.where((F.col("samples") >= min_requests) & (F.col("mean") > 0)
                         & (F.col("std") / F.col("mean") < max_cv))
    periods = median_by(gaps, FUNC, "gap", "period_us")
    return (steady.join(periods, FUNC).where("period_us > 0")
            .select(*FUNC, "period_us", (F.col("std") / F.col("mean")).alias("cv"), "samples", "last_us"))


def polling_gap(learn: DataFrame, detect: DataFrame, split: Split, ready: Learned | None = None, **learning) -> DataFrame:
    """Silences of learned polling, from the last learned request to the end of the capture."""
    polling = ready.polling if ready else stage(learn_polling(learn, **learning))   # small, read four times below
    asked = detect.where("is_req").select(*FUNC, "ts_us", "seq").join(polling.select(*FUNC), FUNC, "left_semi")
    marks = (asked.select(*FUNC, "ts_us", "seq", F.lit(False).alias("is_end"))
             .unionByName(polling.select(*FUNC, F.col("last_us").alias("ts_us"), F.lit(-1).cast("long").alias("seq"),
                                         F.lit(False).alias("is_end")))
             .unionByName(polling.select(*FUNC, F.lit(split.end_us).alias("ts_us"),
                                         F.lit(2 ** 62).alias("seq"), F.lit(True).alias("is_end"))))
    limit = F.greatest(POLL_GAP_FACTOR * F.col("period_us"), F.col("period_us") + POLL_GAP_EXTRA_US)
    rows = (running(marks, FUNC, {"_prev": ("prev", F.col("ts_us"))}).where("_prev IS NOT NULL")
            .withColumn("gap", F.col("ts_us") - F.col("_prev"))
            .join(polling.select(*FUNC, "period_us"), FUNC).withColumn("limit", limit).where("gap > limit"))
    hits = rows.groupBy(*FUNC).agg(
        F.min(F.struct("ts_us", "seq", "_prev", "gap", "is_end", "limit", "period_us")).alias("g"),
        F.count(F.lit(1)).alias("gap_count"), F.max("gap").alias("longest"), F.max("is_end").alias("stopped"))
    hits = hits.withColumn("ts_us", F.greatest((F.col("g._prev") + F.col("g.limit")).cast("long"),
                                               F.lit(split.learn_end_us))).withColumn("seq", F.lit(0).cast("long"))
    return alert(hits, "OT_POLLING_DEVIATION", "MEDIUM", confidence=0.65, mitre=["T0814", "T0815"],
                 evidence={"deviation": F.when(F.col("g.is_end"), "STOPPED").otherwise("INTERRUPTED"),
                           "function_code": F.col("function_code"), "period_us": F.col("g.period_us").cast("long"),
                           "gap_start": F.col("g._prev"), "gap_us": F.col("g.gap"), "gap_count": F.col("gap_count"),
                           "longest_gap": F.col("longest"), "resumed": ~F.col("stopped")})


def polling_storm(learn: DataFrame, detect: DataFrame, periods: int = STORM_PERIODS, factor: float = STORM_FACTOR,
                  width: int = HOUR, ready: Learned | None = None, **learning) -> DataFrame:
    """More requests within a few periods than the learned rhythm explains."""
    limit = int(factor * periods)
    polling = (ready.polling if ready else stage(learn_polling(learn, **learning))).select(*FUNC, "period_us")
    asked = (detect.where("is_req").select(*FUNC, "ts_us", "seq").join(polling, FUNC)
             .withColumn("window", (F.col("period_us") * periods).cast("long")))
    rows = rolling(asked, FUNC, F.col("window"), {"n": ("count", None)}, closed=True, width=width)
    hits = rows.where(F.col("n") > limit).groupBy(*FUNC, "window").agg(
        F.min(F.struct("ts_us", "seq")).alias("first"), F.max("n").alias("max_n"))
    hits = hits.withColumn("ts_us", F.col("first.ts_us")).withColumn("seq", F.col("first.seq"))
    return alert(hits, "OT_POLLING_DEVIATION", "MEDIUM", confidence=0.7, mitre=["T0814"],
                 evidence={"deviation": "STORM", "function_code": F.col("function_code"),
                           "window_us": F.col("window"), "max_in_window": F.col("max_n")})


# --------------------------------------------------------------------------- values

def _written(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("details.is_request"), F.lit(True)) & F.col("write_like") & F.col("num").isNotNull())


def learn_value_range(learn: DataFrame, min_samples: int = VALUE_MIN_SAMPLES) -> DataFrame:
    """Extent, median and spread of the values written to each target."""
    key = ["dst_ip", "protocol", "target"]
    written = _written(learn).select(*key, "num")
    extent = written.groupBy(*key).agg(F.count(F.lit(1)).alias("samples"), F.min("num").alias("min"),
                                       F.max("num").alias("max")).where(F.col("samples") >= min_samples)
    medians = median_by(written, key, "num", "median")
    off = written.join(medians, key).withColumn("off", F.abs(F.col("num") - F.col("median")))
    spread_ = median_by(off, key, "off", "mad")
    return (extent.join(medians, key).join(spread_, key)
            .withColumn("mad_eff", F.greatest("mad", 0.01 * F.abs("median"), F.lit(1e-9))))


def value_out_of_range(learn: DataFrame, detect: DataFrame, factor: float = VALUE_MAD_FACTOR,
                       min_samples: int = VALUE_MIN_SAMPLES) -> DataFrame:
    """Written values outside the learned range and far from its median, one alert per target."""
    key = ["dst_ip", "protocol", "target"]
    ranges = learn_value_range(learn, min_samples)
    rows = (_written(detect).select(*key, "ts_us", "seq", "src_ip", "function_code", "num").join(ranges, key)
            .where(~F.col("num").between(F.col("min"), F.col("max")))
            .withColumn("dev", F.abs(F.col("num") - F.col("median")))
            .where(F.col("dev") > factor * F.col("mad_eff")))
    hits = rows.groupBy(*key).agg(
        F.min(F.struct("ts_us", "seq", "src_ip", "num", "function_code")).alias("first"),
        F.max(F.struct("dev", (-F.col("ts_us")).alias("_t"), (-F.col("seq")).alias("_s"), "num")).alias("worst"),
        F.count(F.lit(1)).alias("n"), F.first("mad_eff").alias("mad_eff"))
    hits = (hits.withColumn("ts_us", F.col("first.ts_us")).withColumn("seq", F.col("first.seq"))
            .withColumn("src_ip", F.col("first.src_ip")))
    return alert(hits, "OT_VALUE_OUT_OF_RANGE", "HIGH", confidence=0.8, mitre=["T0836", "T0831"],
                 evidence={"target": F.col("target"), "value": F.col("first.num"), "extreme_value": F.col("worst.num"),
                           "deviation_mads": F.col("worst.dev") / F.col("mad_eff"), "occurrences": F.col("n")})


def profile(events: DataFrame, fraction: float = 0.3, min_seconds: float = 60.0, min_events: int = 50) -> DataFrame | None:
    """All behavioural alerts of a capture; None when it is too short to judge."""
    split = learning_split(events, fraction, min_seconds, min_events)
    if split is None:
        return None
    learn, detect = split_events(events, split)
    ready = prepare(learn, detect)
    return union([new_master(learn, detect, ready), new_device(learn, detect, ready), new_function(learn, detect, ready),
                  polling_gap(learn, detect, split, ready), polling_storm(learn, detect, ready=ready), value_out_of_range(learn, detect)])
