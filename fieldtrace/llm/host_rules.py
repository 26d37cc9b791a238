"""Quality rules judged by host: rule failures are summed by domain, each rate is shrunk by a beta prior fitted to all
hosts, and the verdict on a host comes back to its documents.

The text is read once for the counts of a document. A host with a third of all documents costs nothing: its failures are
summed in the map tasks before the exchange. The join back to the documents is left to the planner, which
measures the table of hosts and splits a skewed side. Only the prior's sums (one row) reach the driver.

Defined cases: null or empty text has no words and fails; a null host is a host of its own; repeated rows count as often
as they occur; an empty table gives an empty result; extra columns are passed on, and those named like an output are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldtrace.llm.common import query, stage
from fieldtrace.llm.words import PRIME, U64, word_hashes
from fieldtrace.session import configure

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules of which a host's share of failing documents is judged.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "2 * n_dup_lines > n_words",
}
BASE = f"({RULES['few_words']}) OR ({RULES['repeats']})"


def _repeat_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    h = word_hashes(words)
    window = (h[:-2] * U64(PRIME) + h[1:-1]) * U64(PRIME) + h[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i:len(window) + i] |= twice
    return int(covered.sum())


def _counts(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [line for line in text.split(b"\n") if not line.isspace() and line]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words)


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def _count(text: pa.Array) -> pa.Array:
    rows = np.array([_counts(t) for t in text.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], list(COUNTS))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text and base_failed."""
    counted = docs.drop(*[c for c in (*COUNTS, "base_failed") if c in docs.columns]).withColumn("__counts", _count(F.col(text_col)))
    return (counted.withColumns({c: F.col(f"__counts.{c}") for c in COUNTS}).drop("__counts")
            .withColumn("base_failed", F.expr(BASE)))


def beta_prior(hosts: DataFrame, failures: str) -> tuple[float, float]:
    """Alpha and beta of the failure rates of all hosts, by moments.

    The spread between hosts beyond what binomial chance explains gives the prior's weight: none beyond chance means a
    heavy prior, so that single hosts are hardly believed.
    """
    n, k = F.col("n_docs").cast("double"), F.col(failures).cast("double")
    t = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(k).alias("k"),
                  F.sum(k * k / n).alias("kk")).first()
    if not t["hosts"]:
        return 1.0, 1.0
    mean = (t["k"] + 0.5) / (t["n"] + 1)
    spread = t["kk"] - 2 * mean * t["k"] + mean * mean * t["n"]
    room = t["n"] - t["nn"] / t["n"] - t["hosts"] + 1
    share = (spread / (mean * (1 - mean)) - t["hosts"] + 1) / room if room > 0 else 0.0
    weight = 1 / min(max(share, 1e-4), 0.5) - 1
    return mean * weight, (1 - mean) * weight


def host_verdicts(counted: DataFrame, host_col: str = "source", most_failures: float = 0.5) -> DataFrame:
    """(host, n_docs, rate_<rule>..., host_failed) for each host of a table made by ``with_counts``."""
    hosts = stage(counted.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.expr(rule)).alias(f"failed_{name}") for name, rule in RULES.items()]), "hosts")
    for name in RULES:
        alpha, beta = beta_prior(hosts, f"failed_{name}")
        hosts = hosts.withColumn(f"rate_{name}", (F.col(f"failed_{name}") + alpha) / (F.col("n_docs") + alpha + beta))
    return hosts.withColumn("host_failed", F.greatest(*[F.col(f"rate_{name}") for name in RULES]) > most_failures)


def judge(counted: DataFrame, verdicts: DataFrame, host_col: str = "source") -> DataFrame:
    """``kept``: the document passes its own rules and its host passes on the whole."""
    host = verdicts.select(F.col("host").alias("__host"), F.col("host_failed").alias("__failed"))
    return (counted.join(host, F.col(host_col).eqNullSafe(F.col("__host")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("__failed", F.lit(False))).drop("__host", "__failed"))


def host_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", most_failures: float = 0.5) -> DataFrame:
    """``docs`` with the counts, base_failed and kept."""
    configure(docs.sparkSession)
    verdicts = host_verdicts(with_counts(docs.select(text_col, host_col), text_col), host_col, most_failures)
    return judge(with_counts(docs, text_col), verdicts, host_col)


SQL = r"""
WITH split AS (SELECT doc_id, source, coalesce(text, '') AS text,
                      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
toks AS (SELECT doc_id, i, words[i] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM split)),
tri AS (SELECT *, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM toks WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, w3, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM tri) WHERE n > 1 AND w3 IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, s.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN dup d USING (doc_id)),
failed AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > n_words AS f3,
                  2 * n_dup_lines > n_words AS f4 FROM counts),
hosts AS (SELECT source, r, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ([f1, f2, f3, f4][r]) AS DOUBLE) AS k
          FROM failed, range(1, 5) t(r) GROUP BY source, r),
sums AS (SELECT r, count(*) AS h, sum(n) AS n, sum(n * n) AS nn, sum(k) AS k, sum(k * k / n) AS kk, (sum(k) + 0.5) / (sum(n) + 1) AS m FROM hosts GROUP BY r),
weights AS (SELECT r, m, 1 / least(greatest(CASE WHEN n - nn / n - h + 1 > 0 THEN ((kk - 2 * m * k + m * m * n) / (m * (1 - m)) - h + 1)
            / (n - nn / n - h + 1) ELSE 0 END, 0.0001), 0.5) - 1 AS wt FROM sums),
bad AS (SELECT source, bool_or((k + m * wt) / (n + wt) > 0.5) AS host_failed FROM hosts JOIN weights USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed,
       NOT (f1 OR f2) AND NOT host_failed AS kept
FROM failed f JOIN bad b ON f.source IS NOT DISTINCT FROM b.source
"""


@query("op8_host_rules", SQL)
def op8_host_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    counted = stage(with_counts(docs).drop("text"), "counts")
    return judge(counted, host_verdicts(counted)).select("doc_id", *COUNTS, "base_failed", "kept")
