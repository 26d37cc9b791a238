"""Statistical outliers: an isolation forest over event features and a robust cut per operation.

Trees are grown on small random samples, which is the method itself: each tree's
sample is one group of a Spark job. The grown forest is bounded (trees x nodes)
and is shipped to the executors for scoring in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.operators.shaping import alert
from fieldtrace.operators.sliced import median_by
from fieldtrace.session import stage

FEATURES = ["f_score", "f_entropy", "f_size", "f_count", "f_write", "f_control", "f_request", "f_gap", "f_change"]
SERVER_PORTS = [502, 102, 20000, 44818, 2404, 4840, 1883, 8883, 47808]
GROUP = ["protocol", "function_code"]
TREES, SAMPLE = 100, 256


def ml_features(events: DataFrame) -> DataFrame:
    """Nine numeric features of an event; port numbers themselves are left out."""
    op = F.col("operation_type")
    return events.select("*", *[c.cast("double").alias(n) for n, c in zip(FEATURES, [
        F.col("threat_score"), F.col("payload_entropy"), F.octet_length("raw"), F.col("data_count"), op == "WRITE", op == "CONTROL",
        F.col("dst_port").isin(SERVER_PORTS), F.least("time_since_last", F.lit(3600.0)), F.least("payload_change_rate", F.lit(1e6))])])


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, out: list) -> int:
    """Append the subtree of ``x``: rows (feature, cut, left, right, size)."""
    at = len(out)
    out.append(None)
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(x) <= 1 or len(usable) == 0:
        out[at] = (-1, 0.0, -1, -1, len(x))
        return at
    f = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < cut
    left = _grow(x[low], rng, depth + 1, limit, out)
    right = _grow(x[~low], rng, depth + 1, limit, out)
    out[at] = (f, cut, left, right, len(x))
    return at


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    number = int(rows["tree"].iloc[0])
    x = rows.sort_values("pick")[FEATURES].to_numpy()[:SAMPLE]
    nodes: list = []
    _grow(x, np.random.default_rng(number), 0, math.ceil(math.log2(max(len(x), 2))), nodes)
    return pd.DataFrame([(number, i, *n) for i, n in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "size"])


def train_forest(events: DataFrame, seed: int = 42, min_events: int = 100) -> list | None:
    """Grow the forest on standardised features; None for too few events.

    Every event draws a pseudo-random place from its identity, so the samples do not
    depend on how the data is partitioned. The expected sample is about
    ``TREES * SAMPLE`` rows whatever the size of the table.
    """
    rows = ml_features(events)
    total = rows.count()
    if total < min_events:
        return None
    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).first()
    scale = [(stats[f"m_{f}"], stats[f"s_{f}"] or 1.0) for f in FEATURES]
    wanted = TREES * SAMPLE * 1.25
    copies = max(1, math.ceil(wanted / total))          # small tables serve several trees per row
    share = min(1.0, wanted / (total * copies))
    draws = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    pick = F.pmod(F.xxhash64("ts_us", "seq", "_copy", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    tree = F.pmod(F.xxhash64("seq", "ts_us", "_copy", F.lit(seed + 1)), F.lit(TREES)).cast("int")
    sample = draws.withColumn("pick", pick).where(F.col("pick") < share).select(
        tree.alias("tree"), "pick", *[((F.col(f) - m) / s).alias(f) for f, (m, s) in zip(FEATURES, scale)])
    nodes = sample.groupBy("tree").applyInPandas(
        _tree, "tree int, node int, feature int, cut double, left int, right int, size int").collect()
    forest: dict[int, list] = {}
    for n in sorted(nodes, key=lambda r: (r["tree"], r["node"])):
        forest.setdefault(n["tree"], []).append((n["feature"], n["cut"], n["left"], n["right"], n["size"]))
    return [scale, [np.array(t, dtype=float) for t in forest.values()]]


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(n > 2, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


def score_events(events: DataFrame, forest: list) -> DataFrame:
    """Add ``ml_score``: close to -1 for isolated events, above -0.5 for ordinary ones."""
    shared = events.sparkSession.sparkContext.broadcast(forest)     # at most TREES x 2 * SAMPLE nodes

    @F.pandas_udf(T.DoubleType())
    def score(features: pd.DataFrame) -> pd.Series:
        scale, trees = shared.value
        x = (features.to_numpy(dtype=float) - [m for m, _ in scale]) / [s for _, s in scale]
        depth = np.zeros(len(x))
        for t in trees:
            at, level = np.zeros(len(x), dtype=int), np.zeros(len(x))
            while True:
                inner = t[at, 0] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                f = t[at[rows], 0].astype(int)
                low = x[rows, f] < t[at[rows], 1]
                at[rows] = np.where(low, t[at[rows], 2], t[at[rows], 3]).astype(int)
                level[rows] += 1
            depth += level + _average_path(t[at, 4])
        return pd.Series(-(2.0 ** (-(depth / len(trees)) / _average_path(np.array([SAMPLE]))[0])))
    return ml_features(events).withColumn("ml_score", score(F.struct(*FEATURES))).drop(*FEATURES)


def robust_group_outlier(scored: DataFrame, value: str, keys: list[str], min_group: int = 20, factor: float = 4.0,
                         floor: float = 0.05, ceiling: float | None = None) -> DataFrame:
    """Rows far below the median of their group, measured in median absolute deviations."""
    med = median_by(scored, keys, value, "group_median")
    off = scored.join(med, keys).withColumn("_off", F.abs(F.col(value) - F.col("group_median")))
    mad = median_by(off, keys, "_off", "group_mad")
    sizes = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.col("group_median") - F.greatest(F.lit(floor), factor * F.col("group_mad"))
    cut = F.least(F.lit(ceiling), cut) if ceiling is not None else cut
    limits = med.join(mad, keys).join(sizes, keys).where(F.col("_n") >= min_group).withColumn("cutoff", cut).drop("_n")
    return scored.join(limits, keys).where(F.col(value) < F.col("cutoff"))


def ml_outlier(events: DataFrame, seed: int = 42) -> DataFrame | None:
    """Events that stand out both overall and within their own operation."""
    forest = train_forest(events, seed)
    if forest is None:
        return None
    scored = stage(score_events(events, forest))        # six branches read it: scored once
    overall = scored.agg(F.percentile_approx("ml_score", 0.01, 10000)).first()[0] - 0.05
    hits = robust_group_outlier(scored, "ml_score", GROUP, ceiling=overall).where("time_since_last > 0")
    return alert(hits, "ML_ANOMALY", "LOW", confidence=0.5, mitre=F.col("mitre"),
                 evidence={"ml_score": F.col("ml_score"), "group_median_score": F.col("group_median")})
