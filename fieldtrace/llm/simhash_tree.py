"""SimHash near-duplicates through a vantage-point tree of fingerprints.

A text's fingerprint has a bit where more than half of its shingle hashes have it. Equal fingerprints are one point, however many
texts share it. A vantage-point tree cuts the points into shards: a node holds a point and a radius, and points within the radius go one way, the others the other way.
By the triangle inequality a ball of radius ``r`` around a point reaches the inner side only if its distance is at most the radius plus r, and the outer side only if it is more than the radius minus r; so every
point lives in one shard and is also sent, as a query, to the later shards that its ball overlaps. A pair in reach meets where its later point lives.

The tree is shaped by a bounded sample of the points (``SAMPLE``, drawn by hash, worked on in one task); every point is placed. Where the sample
shows no radius that keeps the sides apart (a dense group of near copies), the node stays a shard. A shard is large, as every cut sends
points on as queries, and is dealt out in blocks of points by blocks of queries: of bounded size, and as many as a shuffle has tasks. Inside a block further vantage points cut the points into rings of equal distance; only rings within ``r``
of each other in every one of them are compared, bit by bit, and the result is exact. A block returns one link per point to the
smallest point it is joined with, never the pairs; the components are folded by joins.

For evenly spread fingerprints of 64 bits the bounds prune by a constant share for each vantage point, so the work on pairs grows nearly with the square of the number of distinct fingerprints.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; fewer words than a
shingle has are one shingle; a null id is passed on and is no component's smallest (a component of null ids only has a null one);
repeated rows share a component; an empty table gives an empty result; extra columns are passed on, and those named like an output are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import join_small, query, stage
from fieldtrace.llm.components import components, fold
from fieldtrace.session import configure, width

U64 = np.uint64
K, REACH, SEED = 4, 4, 42
#: Points of a shard, of the sample, of a shard in the sample at least; points and queries of a block, about.
SHARD, SAMPLE, LEAST, POINTS, QUERIES = 65536, 16384, 8, 32768, 131072
#: Shingles whose bits are counted at once; distances computed at once.
SLICE, PAIRS = 1 << 15, 1 << 21
#: Vantage points tried for a node; a split must leave less than this share of the pairs.
TRIES, WORTH = 8, 0.97
#: Vantage points that cut a block into rings, and the points from which on each is worth while.
RINGS, RING_POINTS = 2, 256


# fingerprints


def fingerprint(text: bytes | None, k: int = K, seed: int = SEED) -> int:
    """Majority bits of the hashes of a text's shingles of ``k`` words, A-Z lower-cased, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        at = zip(starts[a:b].tolist(), (ends[np.minimum(np.arange(a, b) + k, len(words)) - 1] - 1).tolist())
        h = np.fromiter((xxhash.xxh64_intdigest(line[i:j], seed) for i, j in at), "<u8", b - a)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * ones > n).astype(U64) @ (U64(1) << np.arange(64, dtype=U64)))


def simhash(text: Column, k: int = K, seed: int = SEED) -> Column:
    """The fingerprint of a text as a long (its 64 bits)."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        return pa.array(np.fromiter((fingerprint(x.as_py(), k, seed) for x in raw), U64, len(raw)).view(np.int64))
    return of(text)


# the tree


def distances(points: np.ndarray, other: np.ndarray | int) -> np.ndarray:
    return np.bitwise_count(points ^ other)


def _split(points: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """(vantage point, radius) that leaves the fewest pairs to compare, if any leaves few enough."""
    best = (WORTH * len(points) ** 2, None)
    for vantage in rng.choice(points, min(TRIES, len(points)), replace=False):
        below = np.concatenate([[0], np.cumsum(np.bincount(distances(points, vantage), minlength=65))])  # points nearer than d
        radius = np.arange(0, 64)
        inner, outer = below[radius + 1], len(points) - below[radius + 1]
        crossing = inner - below[np.maximum(radius + 1 - reach, 0)]  # inner points whose ball reaches outside
        pairs = inner ** 2 + outer ** 2 + 2 * crossing * outer
        pairs = np.where((inner == 0) | (outer == 0), np.inf, pairs)
        at = int(np.argmin(pairs))
        if pairs[at] < best[0]:
            best = (pairs[at], (int(vantage), at))
    return best[1]


def plant(sample: np.ndarray, leaf: float, reach: int = REACH) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inner child, outer child) of a tree whose shards hold about ``leaf`` points of the sample.

    A child below zero is shard -1 - child. Shards are numbered from inside out, so all of a node's inner shards come before its outer ones.
    """
    rng, nodes, shards = np.random.default_rng(len(sample)), [], 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        cut = _split(points, reach, rng) if len(points) > leaf else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        near = distances(points, U64(cut[0])) <= cut[1]
        inner = grow(points[near])
        outer = grow(points[~near])
        nodes[at] = (cut[0], cut[1], inner, outer)
        return at

    grow(sample)
    return nodes


def place(points: np.ndarray, tree: list[tuple[int, int, int, int]], reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the point, shard, whether it lives there) for the home of each point and the later shards within its reach."""
    out, todo = [], [(0 if tree else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((at, np.full(len(at), -1 - node), home))
            continue
        vantage, radius, inner, outer = tree[node]
        d = distances(points[at], U64(vantage)).astype(np.int64)
        # a query goes to later shards only: from an inner home outwards, never back; once a mere query, it goes wherever its ball reaches
        into = np.where(home, d <= radius, d <= radius + reach)
        beyond = d > radius - reach
        todo.append((inner, at[into], home[into]))
        todo.append((outer, at[beyond], (home & (d > radius))[beyond]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


# blocks


def _rings(points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of both from a few vantage points among ``points``, each far from the ones before."""
    far, vantage, of_points, of_queries = np.full(len(points), 0), points[0], [], []
    for _ in range(RINGS if len(points) >= RING_POINTS else 1):
        d = distances(points, vantage).astype(np.int64)
        of_points.append(d)
        of_queries.append(distances(queries, vantage).astype(np.int64))
        far = np.maximum(far, np.abs(d - 32))
        vantage = points[int(np.argmin(far))]  # half of all bits apart from the earlier ones
    return np.array(of_points), np.array(of_queries)


def _cells(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by ring, and the distinct cells with their first and last places."""
    order = np.lexsort(rings[::-1])
    sorted_rings = rings[:, order]
    new = np.concatenate([[True], (np.diff(sorted_rings, axis=1) != 0).any(axis=0)])
    starts = np.flatnonzero(new)
    return order, sorted_rings[:, starts], starts, np.append(starts[1:], rings.shape[1])


def joined(points: np.ndarray, queries: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(point, smallest point joined with it) within a block, for the points and queries that are joined with a smaller one."""
    nodes = np.unique(np.concatenate([points, queries]).view(np.int64))
    label = np.arange(len(nodes))
    of_points, of_queries = _rings(points, queries)
    p_order, p_cells, p_from, p_to = _cells(of_points)
    q_order, q_cells, q_from, q_to = _cells(of_queries)
    p, q = points[p_order], queries[q_order]
    p_node, q_node = np.searchsorted(nodes, p.view(np.int64)), np.searchsorted(nodes, q.view(np.int64))

    for cell, a, b in zip(q_cells.T, q_from, q_to):
        near = np.flatnonzero((np.abs(p_cells - cell[:, None]) <= reach).all(axis=0))
        if not len(near):
            continue
        rows = np.concatenate([np.arange(p_from[i], p_to[i]) for i in near])
        step = max(1, PAIRS // len(rows))
        for i in range(a, b, step):
            hit_q, hit_p = np.nonzero(distances(q[i:min(b, i + step), None], p[None, rows]) <= reach)
            label = fold(label, q_node[i + hit_q], p_node[rows[hit_p]])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(table: pa.Table, reach: int) -> pa.Table:
    fp = np.asarray(table.column("fp")).view(U64)
    points, queries = fp[np.asarray(table.column("point"))], fp[np.asarray(table.column("asks"))]
    a, b = joined(points, queries, reach) if len(points) and len(queries) else (np.zeros(0, np.int64),) * 2
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


# the operator


def _tree(points: DataFrame, total: int, reach: int) -> list[tuple]:
    """The tree, shaped in one task by a bounded sample of the points; what returns is its nodes."""
    share = max(1, total // SAMPLE)
    leaf = max(SHARD / share, LEAST)

    def shape(batches):
        parts = [np.asarray(b.column("fp")) for b in batches]
        sample = np.sort(np.concatenate([np.zeros(0, np.int64), *parts])).view(U64)
        nodes = plant(sample, leaf, reach)
        columns = [np.array([n[k] for n in nodes], U64 if k == 0 else np.int64).view(np.int64) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["vantage", "radius", "inner", "outer"])

    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select("fp").repartition(1)
    rows = sample.mapInArrow(shape, "vantage long, radius long, inner long, outer long").collect()  # at most SAMPLE / leaf nodes
    return [(r["vantage"] % (1 << 64), r["radius"], r["inner"], r["outer"]) for r in rows]


def link(points: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b): links that join all points (column fp, distinct) with a chain of steps of at most ``reach`` bits."""
    total = points.count()
    tree = _tree(points, total, reach)

    def placed(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            at, shard, home = place(fp.view(U64), tree, reach)
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(shard.astype(np.int32)), pa.array(home.astype(bool))], names=["fp", "shard", "home"])

    met = stage(points.select("fp").mapInArrow(placed, "fp long, shard int, home boolean"), "placed")
    # blocks of points (i) and of queries (j): bounded, and in all at least as many as a shuffle has tasks
    shards = len(tree) + 1
    least = math.ceil(math.sqrt(width(points) / shards))
    blocks = lambda n, most: F.greatest(F.ceil(n / most), F.lit(least)).cast("int")
    sizes = (met.groupBy("shard").agg(F.count_if("home").alias("n"), blocks(F.count_if("home"), POINTS).alias("p"), blocks(F.count(F.lit(1)), QUERIES).alias("q"))
             .where("n > 0").drop("n"))
    dealt = met.join(F.broadcast(sizes), "shard")  # a row per shard of the tree, at most SAMPLE / LEAST
    dealt = dealt.withColumns({"i0": F.pmod(F.xxhash64("fp", F.lit(7)), "p").cast("int"), "j0": F.pmod(F.xxhash64("fp", F.lit(11)), "q").cast("int")})
    place_in = lambda i, j, point, asks: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), point.alias("point"), asks.alias("asks"))
    row, column = F.sequence(F.lit(0), F.col("q") - 1), F.sequence(F.lit(0), F.col("p") - 1)
    # a query meets every block of points; a point of the shard is in its block for every block of queries too
    asked = F.transform(F.filter(column, lambda i: ~F.col("home") | (i != F.col("i0"))), lambda i: place_in(i, F.col("j0"), F.lit(False), F.lit(True)))
    lives = F.transform(row, lambda j: place_in(F.col("i0"), j, F.lit(True), j == F.col("j0")))
    places = F.when(F.col("home"), F.concat(asked, lives)).otherwise(asked)
    return (dealt.select("shard", "fp", F.explode(places).alias("at")).select("shard", "at.*", "fp")
            .groupBy("shard", "i", "j").applyInArrow(lambda t: _links(t, reach), "a long, b long"))


def near_copies(printed: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", reach: int = REACH) -> DataFrame:
    """``printed``, which has a fingerprint in ``fp_col``, with component_id: the smallest id reachable by links."""
    configure(printed.sparkSession)
    points = stage(printed.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "points")
    label = components(stage(link(points, reach), "links"))
    grouped = stage(points.join(label.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 or label is not null")
                    .select("fp", "least", F.coalesce("label", "fp").alias("label")), "grouped")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    table = stage(grouped.join(least, "label").select(F.col("fp").alias("__fp"), F.col("component_id").alias("__component")), "table")
    rows = printed.withColumn("__fp", F.col(fp_col)).drop("component_id")
    return join_small(rows, table, "__fp", "left").withColumn("component_id", F.coalesce("__component", id_col)).drop("__fp", "__component")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, reach: int = REACH) -> DataFrame:
    """``docs`` with fingerprint (16 hexadecimal digits) and component_id."""
    printed = stage(docs.withColumn("__print", simhash(F.col(text_col), k)), "printed")
    return near_copies(printed, id_col, "__print", reach).withColumn("fingerprint", hexadecimal("__print")).drop("__print")


def hexadecimal(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


@query("op12_simhash_tree")
def op12_simhash_tree(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    printed = stage(docs.select("doc_id", simhash(F.col("text")).alias("fp")), "printed")
    return near_copies(printed).select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")
