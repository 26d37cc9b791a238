"""Quality classifier by importance resampling.

Words and word pairs are hashed into a fixed number of buckets. A generative model of the target (labelled as good) and one of the raw
text (all documents) are the smoothed shares of the buckets; a document's log weight is the sum of the log ratios of
its n-grams, and the k largest of log weight plus Gumbel noise are a sample without replacement by weight. k follows the share
of good ones among the labels. The noise comes from a hash of the row, so it is the same at every run.

Both models are sums over Arrow batches, one row per bucket and task. The target is learned from at most about ``most_labels``
labelled documents, chosen by hash; the raw model, the weights and the sample cover all documents. The k-th largest key
is found by counting in bins that are refined until it is exact; no rows are sorted or collected for it.

Defined cases: a null or empty text has log weight 0; a null id has no label; labels repeated for an id count once, as good if any is;
rows at the k-th key are all selected; without good labels nothing is known against any document and all are selected; an empty
table gives an empty result; extra columns are passed on, and those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldtrace.llm.common import query, row_key, stage
from fieldtrace.llm.words import U64, all_hashes, chunks, inside, windows
from fieldtrace.session import configure

BUCKETS, MOST_LABELS, BINS, SEED = 1 << 16, 20_000, 4096, 17


def _features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all words and pairs of neighbouring words."""
    h, counts = all_hashes(texts, lower=True)
    owner = np.repeat(np.arange(len(counts)), counts)
    valid = inside(counts, 2)
    both = np.concatenate([windows(h, 1), windows(h, 2)[valid]])
    return np.concatenate([owner, owner[:len(valid)][valid]]), (both & U64(BUCKETS - 1)).astype(np.int64)


def _sums(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for rows, texts in chunks(batch):
            owner, bucket = _features(texts)
            good = np.asarray(rows.column("good").fill_null(False).to_numpy(zero_copy_only=False), bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[owner]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of each bucket, target over raw. ``good_ids``: (id), at most MOST_LABELS rows or so."""
    flagged = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
               .join(F.broadcast(good_ids.withColumn("good", F.lit(True))), "id", "left").select("text", "good"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    sums = flagged.mapInArrow(_sums, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    for bucket, r, t in sums.collect():  # a row for each bucket
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    # what both models see of a bucket is smoothed towards the raw share
    share = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + 50 * share * BUCKETS / 100) / (target.sum() + 50 * BUCKETS / 100)) - np.log(share)


def with_weights(docs: DataFrame, ratios: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with log_weight, the sum of the log ratios of the text's n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf(DoubleType())
    def weigh(text: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for _, texts in chunks(pa.RecordBatch.from_arrays([text], names=["text"])):
            owner, bucket = _features(texts)
            out.append(np.bincount(owner, weights=shared.value[bucket], minlength=len(texts)))
        return pa.array(np.round(np.concatenate(out), 9))

    return docs.withColumn("log_weight", weigh(F.col(text_col)))


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value of a column of finite doubles, by counting in ever finer bins."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / BINS
        if width == 0 or low + width == low:
            break
        inner = values.where(F.col(column).between(low, high))
        bins = inner.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        above = values.where(F.col(column) > high).count()
        for row in bins:
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return high


def importance_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None,
                      most_labels: int = MOST_LABELS) -> DataFrame:
    """``docs`` without its text, with log_weight and selected. ``labels``: (id, quality), 1 for good."""
    configure(docs.sparkSession)
    known = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max("quality").alias("quality")))
    n, good = known.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    part = min(1.0, most_labels / max(good, 1))
    chosen = known.where((F.col("quality") == 1) & (F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < int(part * (1 << 20)))).select("id")
    ratios = log_ratios(docs, chosen, id_col, text_col)
    h = F.pmod(F.xxhash64(row_key(F.col(id_col), F.col(text_col)), F.lit(SEED)), F.lit(1 << 52))
    noise = -F.log(-F.log((h + 0.5) / float(1 << 52)))
    weighed = stage(with_weights(docs.drop("log_weight", "selected"), ratios, text_col).withColumn("__key", F.col("log_weight") + noise).drop(text_col), "weights")
    if not good:
        return weighed.withColumn("selected", F.lit(True)).drop("__key")
    k = round(weighed.count() * (share if share is not None else good / n))
    if k == 0:
        return weighed.withColumn("selected", F.lit(False)).drop("__key")
    return weighed.withColumn("selected", F.col("__key") >= kth_largest(weighed, "__key", k)).drop("__key")


@query("op6_importance")
def op6_importance(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    return importance_sample(docs, labels)
