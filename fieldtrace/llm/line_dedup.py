"""Line dedup: hashes of lines are dealt by range with a secondary order by document and position; first occurrences
stay, and what goes back to a document is a run-length-coded bitmap of its lines, never text.

Only DataFrame functions. Lines travel as 128-bit hashes. A line in a third of all documents is spread over many
range partitions, since the range key goes on with document and position; each partition reduces it to one row before
the small exchange by hash, and the join back to the occurrences can be split by the planner.

Defined cases: null or empty text is one empty line; null ids count as one unknown document, smaller than any other;
repeated rows are one document and get equal results; ties on the largest id all keep the line; an empty table gives
an empty result; extra columns are passed on, and those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import SPACES, let, lower_ascii, query, row_key, stage
from fieldtrace.session import configure


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(h1, h2, id, rk, pos) of each line whose key has at least ``min_chars`` code points; (h1, h2) is its 128-bit hash."""
    key = lower_ascii(F.btrim(F.col("line"), F.lit(SPACES)))
    return (docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"),
                        F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
            .where(F.char_length("line") >= min_chars)
            .select("id", "rk", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
            .select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), "id", "rk", "pos"))


def repeated_lines(occ: DataFrame, min_docs: int = 5) -> DataFrame:
    """(h1, h2, keep_id): lines found in at least ``min_docs`` documents, and the document that keeps them.

    In a range partition the rows of a line stand together, largest document first, so its first occurrence and its
    documents fold in one streaming pass; a line that crosses partitions is merged from one row of each.
    """
    ordered = [F.col("h1"), F.col("h2"), F.col("id").desc(), F.col("pos")]
    dealt = occ.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    return (dealt.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keep_id"))
            .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keep_id"))


def dropped_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                 min_docs: int = 5) -> DataFrame:
    """(rk, runs): per document that loses lines, its bitmap as runs of dropped lines (first, length)."""
    occ = stage(occurrences(docs, id_col, text_col, min_chars), "lines")
    # written, so that the join below stands right on its exchanges and the planner can split a line's rows
    lost = (occ.join(stage(repeated_lines(occ, min_docs), "repeated"), ["h1", "h2"])
            .where(F.col("id").isNull() | (F.col("id") < F.col("keep_id"))))
    at = lost.groupBy("rk").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    runs = let(F.col("at"), lambda a: let(
        F.struct(F.filter(a, lambda p, i: (i == 0) | (F.get(a, i - 1) != p - 1)).alias("first"),
                 F.filter(a, lambda p, i: (i == F.size(a) - 1) | (F.get(a, i + 1) != p + 1)).alias("last")),
        lambda e: F.zip_with(e["first"], e["last"], lambda f, l: F.struct(f.alias("first"), (l - f + 1).alias("length")))))
    return at.select("rk", runs.alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5) -> DataFrame:
    """``docs`` with its text rebuilt from the lines that stay, plus n_lines, n_dropped and dropped_runs.

    A line is judged by its key: white space stripped at both ends, A-Z lower-cased. A key of at least ``min_chars``
    code points in at least ``min_docs`` documents stays only in the largest id holding it.
    """
    configure(docs.sparkSession)
    runs = dropped_runs(docs, id_col, text_col, min_chars, min_docs).withColumnsRenamed({"rk": "__rk", "runs": "__runs"})
    text = F.col(text_col)
    kept = let(F.struct(_lines(text).alias("lines"), F.flatten(F.transform(
        "__runs", lambda r: F.sequence(r["first"], r["first"] + r["length"] - 1))).alias("gone")),
        lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]),
                                           lambda i: F.get(s["lines"], i)), "\n"))
    # the runs are the small side: hashing them spares a sort of the texts
    joined = docs.withColumn("__rk", row_key(F.col(id_col), text)).join(runs.hint("shuffle_hash"), "__rk", "left")
    none = F.expr("array_repeat(named_struct('first', 0, 'length', 0), 0)")
    return joined.withColumns({
        "n_lines": F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) + 1,
        "n_dropped": F.coalesce(F.aggregate("__runs", F.lit(0), lambda a, r: a + r["length"]), F.lit(0)),
        "dropped_runs": F.coalesce("__runs", none),
        text_col: F.when(F.col("__runs").isNull(), text).otherwise(kept)}).drop("__rk", "__runs")


SQL = r"""
WITH lines AS (
  SELECT doc_id, p AS pos, string_split(coalesce(text, ''), chr(10))[p] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < h.keep_id, false) AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op10_line_dedup", SQL)
def op10_line_dedup(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                                   F.col("n_dropped").cast("long").alias("n_dropped"),
                                   F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
