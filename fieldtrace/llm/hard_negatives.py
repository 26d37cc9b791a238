"""Hard-negative mining with Fagin's threshold algorithm over sharded, per-dimension sorted lists.

The rows are dealt into shards of bounded size by a hash of their id, so that a label or a repeated vector that holds a third
of all rows is spread like any other. A shard sorts its rows once along every dimension. For an anchor, sorted access walks all lists at the
same depth, from the large end where the anchor's component is positive and from the small end where it is negative (lists of zero components cannot
add to a score and are left out). Each row met for the first time is looked up whole (random access) and scored in integers. The sum of the
anchor's components times the values at the present depth is the threshold: no row not yet met can score more. An anchor is
done with a shard once the threshold is strictly below the k-th score of each of its windows (or below all that the window
admits), strictly, because a row with an equal score and a smaller id would come first. What the shards answer, k rows a
window, is merged by one ranked window. The result is exact.

Anchors meet every shard in blocks of bounded size; no list of rows or anchors passes through the driver.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows that share
an id the least by label and vector counts; vectors of other lengths are filled with zeros; components are floor(256 x), held within 2^24 on
either side so that scores fit 64 bits; ties go to the smaller id; anchors without a positive, and
positives whose window is empty, have no rows; an empty table gives an empty result; columns other than id, label and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import query, stage
from fieldtrace.session import configure, width

#: Rows of a shard at most and at least, anchors of a block, about; first depth of sorted access.
SHARD, SMALL, BLOCK, DEPTH = 8192, 1024, 4096, 32
LARGEST = float(1 << 24)


def prepared(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, q): the rows that take part, q the integer components."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    q = F.transform(x, lambda e: F.greatest(F.least(F.floor(e.cast("double") * 256).cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), q.alias("q")).where(sound)
    return rows.where("id is not null and label is not null").groupBy("id").agg(F.min(F.struct("label", "q")).alias("v")).select("id", "v.*")


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = np.asarray(lists.flatten())
    return out


class Shard:
    """Rows of a shard with their sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)  # a smaller place is a smaller id
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()  # per dimension, ascending
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)

    def search(self, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most score; None: open) the places and scores of its first k rows among ``wanted`` rows."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        depth, step = 0, DEPTH
        while depth < n:
            to = min(n, depth + step)
            met = np.zeros(n, bool)
            if len(up) + len(down):
                met[self.lists[up, n - to:n - depth]] = True
                met[self.lists[down, depth:to]] = True
                last = int(anchor[up] @ self.values[up, n - to] + anchor[down] @ self.values[down, to - 1])
            else:  # every score is 0
                met[:], to, last = True, n, 0
            new = np.flatnonzero(met & ~seen & wanted)
            seen |= met
            scores = self.vectors[new] @ anchor
            open_windows = False
            for i, (least, most) in enumerate(windows):
                fits = np.ones(len(new), bool)
                if least is not None:
                    fits &= scores >= least
                if most is not None:
                    fits &= scores <= most
                place, score = np.concatenate([best[i][0], new[fits]]), np.concatenate([best[i][1], scores[fits]])
                first = np.lexsort((place, -score))[:k]
                best[i] = place[first], score[first]
                kth = int(best[i][1][-1]) if len(first) == k else None
                bound = max(x for x in (kth, least, -(1 << 62)) if x is not None)
                open_windows |= not last < bound
            if not open_windows or seen.all():
                break
            depth, step = to, step * 2
        return best


def _answers(rows: pa.Table, anchors: pa.Table, positives: bool, k: int, low: int, high: int) -> pa.Table:
    """One shard and one block of anchors: (anchor, positive, positive_score, id, score); positives: the nearest of the same
    label, else the negatives of each positive's window."""
    out = [[] for _ in range(5)]
    if rows.num_rows and anchors.num_rows:
        dims = max(int(pa.compute.max(pa.compute.list_value_length(t.column("q"))).as_py()) for t in (rows, anchors))
        shard = Shard(np.asarray(rows.column("id")), np.asarray(rows.column("label")), _matrix(rows.column("q"), dims))
        vectors = _matrix(anchors.column("q"), dims)
        lists = [[]] * anchors.num_rows if positives else anchors.column("positives").to_pylist()
        for a, label, v, own in zip(anchors.column("id").to_pylist(), anchors.column("label").to_pylist(), vectors, lists):
            if positives:
                found = [(None, None, *x) for x in shard.search(v, (shard.labels == label) & (shard.ids != a), [(None, None)], k)]
            else:  # low * p <= 100 * n <= high * p
                bounds = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in own]
                held = [(p, b) for p, b in zip(own, bounds) if b[0] <= b[1]]
                answers = shard.search(v, shard.labels != label, [b for _, b in held], k) if held else []
                found = [(p["id"], p["score"], *x) for (p, _), x in zip(held, answers)]
            for p, s, place, score in found:
                for column, value in zip(out, ([a] * len(place), [p] * len(place), [s] * len(place), shard.ids[place].tolist(), score.tolist())):
                    column += value
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "positive", "positive_score", "id", "score"), out)})


def _met(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, **how) -> DataFrame:
    """Every block of anchors against every shard of rows, one task each."""
    wide = anchors if "positives" in anchors.columns else anchors.withColumn("positives", F.lit(None).cast("array<struct<id: bigint, score: bigint>>"))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                       "id", "label", "q", F.lit(None).cast(wide.schema["positives"].dataType).alias("positives"), F.lit(False).alias("anchor"))
    right = wide.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                        "id", "label", "q", "positives", F.lit(True).alias("anchor"))

    def answers(both: pa.Table) -> pa.Table:
        mark = both.column("anchor")
        return _answers(both.filter(pa.compute.invert(mark)), both.filter(mark), **how)

    return left.unionByName(right).groupBy("shard", "block").applyInArrow(answers, "anchor long, positive long, positive_score long, id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``. A negative's score is at least ``low`` and at most ``high`` percent of the positive's.
    """
    configure(vectors.sparkSession)
    rows = stage(prepared(vectors, id_col, label_col, vector_col), "vectors")
    anchors = rows.where(is_anchor)
    total = rows.count()
    # a task of a shuffle each, but none so small that k answers a window from every shard outweigh its rows
    shards = max(1, -(-total // SHARD), min(width(rows), total // SMALL))
    blocks = max(1, -(-anchors.count() // BLOCK))
    order = [F.desc("score"), F.asc("id")]
    near = (_met(rows, anchors, shards, blocks, positives=True, k=n_positives, low=low, high=high)
            .withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= n_positives))
    with_positives = stage(near.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("positives")), "positives")
    found = _met(rows, anchors.join(with_positives, "id"), shards, blocks, positives=False, k=n_negatives, low=low, high=high)
    return (found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order)))
            .where(F.col("rank") <= n_negatives)
            .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i])) AS BIGINT) AS score
  FROM sound a JOIN sound r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM scored WHERE same) WHERE n <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    relabelled = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(relabelled, F.col("id") % 100 == 0)
