"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Texts with equal shingle sets are one node. A pair at or above the threshold must share a shingle among the first
n - ceil(t n) + 1 of each side in any fixed order; here rare shingles come first (unique, repeated, frequent, from the filters of
``sketch``), and unique ones need not be sent at all. Nodes that share such a shingle, directly or through others, form a
candidate group: stars around the smallest node of each shingle's list, not pairs. Groups are cut into blocks of bounded
size; the product of two blocks accumulates the overlap of all their nodes over all their shingles in one matrix, and pairs
below the bound given by their sizes fall away. Only repeated shingles travel with a node, next to the size of its whole set: no other
node has the unique ones. A product returns one link for two parts that it joins, never the pairs. In a group of
several blocks, nodes of the same least shingle, as near copies mostly have, lie in one block, or in several if they are too many. The largest part of
the first round, which lies in one block, then visits all others, and the largest part of each least shingle the other blocks of that; only the nodes left outside the
group's largest part after that visit further blocks, those in which nodes of a fitting size and of another part share with them as many shingles of the prefix as the bound
asks for: two sets with an overlap of o share more than o - ceil(t m) of the first m - ceil(t m) + 1, m the larger size. So a group of thousands of near copies costs a few
products per block, a group of unlike texts that chance has joined few visits, and links stay below the number of nodes. All links between different texts count, and none is sampled.
Shingle hashes have 64 bits.

Defined cases: null or empty text has no shingles and links with nothing; fewer than ``k`` words are one shingle; a null id
is passed on, and is not a component's smallest; repeated rows share a component; an empty table gives an empty result; extra columns are
passed on, and those named like an output are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from fieldtrace.llm import sketch
from fieldtrace.llm.common import join_small, query, row_key, stage
from fieldtrace.llm.components import components, fold
from fieldtrace.llm.words import U64, all_hashes, chunks, inside, mix, windows
from fieldtrace.session import configure

K, NUM, DEN = 5, 4, 5
#: Counts from which a shingle is repeated, frequent.
LEVELS = (2, 16)
#: Shingles and nodes of one block, about.
BLOCK_SHINGLES, BLOCK_NODES, COLUMNS = 1 << 16, 256, 4096
#: Ratio of the sizes that visits count together.
SIZES = 1.06
#: A node: the key and size of its set, its candidate group, the blocks of that and the one that it lies in.
NODE = ("key", "n", "group", "blocks", "block")


def shingle_sets(texts: list[bytes | None], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle) sorted and distinct, and the sizes of the texts' sets."""
    h, counts = all_hashes(texts, lower=True)
    valid = inside(counts, k)
    owner = np.repeat(np.arange(len(counts)), counts)[:len(valid)][valid]
    shingle = windows(h, k)[valid]
    start = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        owner = np.concatenate([owner, short])
        shingle = np.concatenate([shingle, [windows(h[start[i]:start[i + 1]], int(counts[i]))[0] for i in short]]).astype(U64)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    owner, shingle = owner[new], shingle[new]
    return owner, shingle, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def _set_keys(shingle: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    out = np.zeros(len(sizes), U64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(shingle), (np.cumsum(sizes) - sizes)[full]) ^ sizes[full].astype(U64))
    return out


def _sketch_rows(batches, buckets: int, k: int):
    for batch in batches:
        for _, texts in chunks(batch):
            owner, shingle, sizes = shingle_sets(texts, k)
            first = np.zeros(len(sizes), bool)
            first[np.unique(_set_keys(shingle, sizes), return_index=True)[1]] = True
            shingle = shingle[first[owner]]
            values, counts = np.unique(sketch.keys(shingle, shingle, buckets), return_counts=True)
            yield sketch.pack(np.repeat(values, np.minimum(counts, LEVELS[-1])))


def _prefix_rows(batches, planes, bits: int, buckets: int, k: int, num: int, den: int):
    """Per text: size and key of its set, how many of its shingles are repeated, the least of those, and those of its prefix."""
    for batch in batches:
        for rows, texts in chunks(batch):
            owner, shingle, sizes = shingle_sets(texts, k)
            code = sketch.keys(shingle, shingle, buckets)
            level = np.zeros(len(code), np.int8)
            some = np.flatnonzero(sketch.maybe(planes.value[0], code, bits))
            level[some] = 1 + sketch.maybe(planes.value[1], code[some], bits)
            length = sizes - -(-sizes * num // den) + 1
            unique = np.bincount(owner[level == 0], minlength=len(sizes))
            left = (length - unique).clip(0)  # places of the prefix that repeated shingles take
            at = some[left[owner[some]] > 0]
            at = at[np.lexsort((shingle[at], level[at], owner[at]))]
            n = np.bincount(owner[at], minlength=len(sizes))
            rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            at = at[rank < left[owner[at]]]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(sizes)))])
            values = np.ascontiguousarray(shingle[at])
            blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(values)])
            repeated = np.bincount(owner[some], minlength=len(sizes))
            least = np.zeros(len(sizes), U64)
            full = repeated > 0
            least[full] = shingle[some][(np.cumsum(repeated) - repeated)[full]]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("rk"), pa.array(sizes), pa.array(_set_keys(shingle, sizes).view(np.int64)), pa.array(repeated),
                                              pa.array(least.view(np.int64)), blobs], names=["id", "rk", "n", "key", "repeated", "least", "prefix"])


def _entries(batches):
    for batch in batches:
        blobs = batch.column("prefix").to_pylist()
        values = np.frombuffer(b"".join(blobs), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("key")), [len(b) // 8 for b in blobs])), pa.array(values)], names=["key", "shingle"])


def _set_rows(batches, planes, bits: int, buckets: int, k: int):
    """The nodes with the repeated shingles of their sets."""
    for batch in batches:
        for rows, texts in chunks(batch):
            owner, shingle, sizes = shingle_sets(texts, k)
            some = sketch.maybe(planes.value[0], sketch.keys(shingle, shingle, buckets), bits)
            ends = (np.concatenate([[0], np.cumsum(np.bincount(owner[some], minlength=len(sizes)))]) * 8).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(shingle[some]))])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in NODE), blobs], names=[*NODE, "shingles"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The product of two incidence matrices: shared shingles of each pair, accumulated over slices of columns."""
    parts = [*left, *right]
    _, column, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    shared = counts[column] > 1
    place = np.cumsum(counts > 1) - 1
    row, column = row[shared], place[column[shared]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + COLUMNS, COLUMNS)) if len(column) else []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        block = np.zeros((len(parts), COLUMNS), np.float32)
        block[row[a:b], column[a:b] - i * COLUMNS] = 1
        out += block[:len(left)] @ block[len(left):].T
    return out.astype(np.int64)


def _links(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links found by one product: of a block with itself, or of its nodes with visitors. Nodes of one part need no
    comparison, and of the links between two parts one is returned."""
    key, part, visits, sizes = (np.asarray(table.column(c)) for c in ("key", "part", "visits", "n"))
    sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
    _, first, label = np.unique(part, return_index=True, return_inverse=True)
    a = np.flatnonzero(~visits)
    b = np.flatnonzero(visits) if visits.any() else a
    edges = np.zeros((0, 2), np.int64)
    if len(a) and len(b):
        both = _overlaps([sets[i] for i in a], [sets[i] for i in b])
        i, j = np.nonzero(both * (num + den) >= num * (sizes[a][:, None] + sizes[b][None, :]))
        own = np.arange(len(first))
        joined = fold(own, label[a[i]], label[b[j]])
        moved = np.flatnonzero(joined != own)
        edges = np.stack([key[first[joined[moved]]], key[first[moved]]], axis=1)
    return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the part that the links so far put them in."""
    label = components(links).withColumnsRenamed({"node": "key", "label": "_part"})
    return nodes.drop("part").join(label, "key", "left").withColumn("part", F.coalesce("_part", "key")).drop("_part")


def _largest(nodes: DataFrame, *within: str) -> DataFrame:
    """The largest part of each group, or other set of nodes."""
    return nodes.groupBy(*within, "part").agg(F.count(F.lit(1)).alias("n")).groupBy(*within).agg(F.max_by("part", F.struct("n", "part")).alias("core"))


def _blocks_for(shingles: Column, nodes: Column) -> Column:
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(nodes / BLOCK_NODES), F.lit(1)).cast("int")


def _placing(one: DataFrame) -> DataFrame:
    """``one`` (nodes with their groups) with the number of blocks of the group and the block of the node. Nodes of one least shingle lie in one block, or
    in ``spread`` blocks from ``base`` on."""
    size = F.sum("repeated"), F.count(F.lit(1))
    blocks = one.groupBy("group").agg(_blocks_for(*size).alias("blocks"))
    cells = one.groupBy("group", "least").agg(_blocks_for(*size).alias("spread"))
    found = one.join(cells, ["group", "least"]).join(blocks, "group").withColumn("spread", F.least("spread", "blocks"))
    found = found.withColumn("base", F.pmod(F.xxhash64("least", F.lit(5)), "blocks").cast("int"))
    return found.withColumn("block", F.pmod(F.col("base") + F.pmod(F.xxhash64("key"), "spread"), "blocks").cast("int"))


def _core_visits(placed: DataFrame) -> DataFrame:
    """Visits (group, to, key, part) of the largest part of a group to its other blocks, and of the largest part of a least shingle to the other blocks of that."""
    core = placed.join(_largest(placed, "group"), "group").where("part = core").withColumn("to", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = placed.where("spread > 1")
    cell = (spread.join(_largest(spread, "group", "least"), ["group", "least"]).where("part = core")
            .withColumn("to", F.explode(F.expr("transform(sequence(0, spread - 1), x -> (base + x) % blocks)"))))
    return core.unionByName(cell).where("to <> block").select("group", "to", "key", "part").distinct()


def _further_visits(entries: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """Visits of the nodes outside the largest part of their group to blocks that may hold nodes they link with. Of two such nodes the one of the lower block visits."""
    marked = stage(placed.join(_largest(placed, "group"), "group").select("group", "block", "key", "n", "part", F.expr("part <> core").alias("outside")), "marked")
    held = stage(join_small(entries, marked, "key", "inner").select("group", "shingle", "block", "key", "n", "part", "outside"), "held")
    asked = held.where("outside").select("group", "shingle", F.col("block").alias("own"), "key", "n", F.col("part").alias("mine"))
    there = held.groupBy("group", "shingle", F.col("block").alias("to"), F.floor(F.log("n") / math.log(SIZES)).alias("size")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("part").alias("one"), F.max("part").alias("other"), F.min("outside").alias("outside"))
    met = asked.join(there, ["group", "shingle"]).where((F.col("to") > F.col("own")) | ((F.col("to") < F.col("own")) & ~F.col("outside")))
    met = met.where(f"n * {den} >= lo * {num} and hi * {den} >= n * {num} and not (one = mine and other = mine)")
    shared = met.groupBy("group", "key", "to", "size").agg(F.count(F.lit(1)).alias("shared"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"), F.first("mine").alias("part"))

    def least(size: str) -> str:  # times den * (num + den); as a function of the other size it rises, then falls, so the ends of a range have the smallest
        return f"{num * den} * (n + {size}) - {num * (num + den)} * greatest(n, {size})"
    return shared.where(f"shared * {den * (num + den)} >= least({least('lo')}, {least('hi')})").select("group", "key", "to", "part").distinct()


def _products(nodes: DataFrame, placed: DataFrame, visitors: DataFrame, num: int, den: int) -> DataFrame:
    """Links of visitors (``to``: the block they visit) with the nodes of that block, so many visitors at a time as a block has nodes.
    Only ``nodes`` has the sets; who meets whom is settled without them."""
    crowd = visitors.groupBy("group", "to").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).cast("int").alias("turns")).withColumnRenamed("to", "block")
    hosts = placed.join(crowd, ["group", "block"]).select("group", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "key", "part", F.lit(False).alias("visits"))
    guests = (visitors.withColumnRenamed("to", "block").join(crowd, ["group", "block"])
              .select("group", "block", F.pmod(F.xxhash64("key", F.lit(3)), "turns").cast("int").alias("turn"), "key", "part", F.lit(True).alias("visits")))
    meeting = stage(hosts.unionByName(guests), "meeting")
    return (join_small(nodes.select("key", "n", "shingles"), meeting, "key", "inner")
            .groupBy("group", "block", "turn").applyInArrow(lambda t: _links(t, num, den), "a long, b long"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, rk, n, key, component, first): per row of ``docs`` the size and key of its set, the smallest id reachable by links, and the key
    of the row that stands for its component."""
    spark = configure(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    buckets, bits = sketch.plan(docs.count())
    seen = sketch.Repeated(texts.select("text").mapInArrow(lambda b: _sketch_rows(b, buckets, k), sketch.PACKED), buckets, bits, LEVELS)
    planes, per_bucket = seen.filter, seen.bits
    schema = StructType([StructField("id", id_type), *[StructField(c, LongType()) for c in ("rk", "n", "key", "repeated", "least")], StructField("prefix", BinaryType())])
    rows = stage(texts.mapInArrow(lambda b: _prefix_rows(b, planes, per_bucket, buckets, k, num, den), schema), "sets")

    # candidate groups: the nodes of a shingle's list hang on its smallest node
    every = stage(rows.where(F.octet_length("prefix") > 0).select("key", "prefix").mapInArrow(_entries, "key long, shingle long").distinct(), "entries")
    lists = every.groupBy("shingle").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle", "first")
    # what follows reads only the shingles that two nodes have
    entries = stage(every.join(lists, "shingle"), "entries")
    stars = entries.where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct()
    group = components(stars).select(F.col("node").alias("key"), F.col("label").alias("group"))

    one = stage(rows.join(group, "key").groupBy("key", "group").agg(F.min("rk").alias("rk"), F.max("n").alias("n"), F.max("repeated").alias("repeated"), F.max("least").alias("least")), "nodes")
    placing = stage(_placing(one).select("rk", "key", "n", "group", "blocks", "block", "least", "spread", "base"), "placing")
    # a text meets its place before its set is cut, so that sets travel only to their blocks
    nodes = stage(join_small(texts.select("rk", "text"), placing, "rk", "inner").select(*NODE, "text").mapInArrow(
        lambda b: _set_rows(b, planes, per_bucket, buckets, k), "key long, n long, group long, blocks int, block int, shingles binary"), "nodes")

    alone = nodes.select("group", "block", "key", "n", F.col("key").alias("part"), "shingles", F.lit(False).alias("visits"))
    links = stage(alone.groupBy("group", "block").applyInArrow(lambda t: _links(t, num, den), "a long, b long"), "links")
    wide = placing.where("blocks > 1").drop("rk")
    if not wide.isEmpty():
        # largest parts lie in one block; they visit the others
        placed = stage(_parts(wide, links), "parts")
        links = stage(links.unionByName(_products(nodes, placed, stage(_core_visits(placed), "visits"), num, den)), "links")
        # nodes still outside the largest part of their group visit the blocks that may hold nodes they link with
        placed = stage(_parts(placed, links), "parts")
        guests = stage(_further_visits(entries, placed, num, den), "guests")
        if not guests.isEmpty():
            links = links.unionByName(stage(_products(nodes, placed, guests, num, den), "links"))

    part = components(links).select(F.col("node").alias("key"), F.col("label").alias("part"))
    placed = rows.join(part, "key", "left").select("id", "rk", "n", "key", F.when(F.col("n") > 0, F.coalesce("part", "key")).alias("part"))
    least = placed.where("part is not null").groupBy("part").agg(
        F.min("id").alias("least"), F.min_by("rk", F.struct(F.col("id").isNull(), "id", "rk")).alias("first"))
    return (placed.join(stage(least, "least"), "part", "left")
            .select("id", "rk", "n", "key", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component"), "first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, and of rows equal in id and text any one. Rows without words all stay."""
    found = stage(classes(docs, id_col, text_col, k, num, den).where("n > 0").select("rk", "first"), "classes")
    gone = stage(found.where("rk <> first").select(F.col("rk").alias("__rk")).distinct(), "gone")
    equal = stage(found.where("rk = first").groupBy(F.col("rk").alias("__rk")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__rk"), "equal")
    keyed = docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col)))
    left = join_small(keyed, gone, "__rk", "left_anti")
    if equal.isEmpty():
        return left.drop("__rk")
    return (join_small(left, equal, "__rk", "left_anti").unionByName(join_small(left, equal, "__rk", "left_semi").dropDuplicates(["__rk"]))).drop("__rk")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON s.doc_id = r.a
"""


@query("op9_ngram_join", SQL)
def op9_ngram_join(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
