"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is a position in a text. Its group is the hash of its first words: 8 at first, 16 or 35 where a group would
hold more suffixes than one task should (the sizes are counted beforehand). In a group the suffixes are put in order of
their first 35 words, which lays out the leaves of its subtree; an internal node of depth 35 or more is a run of equal
neighbours, and each of its leaves starts a repeated window. Overlapping windows of a text join to its maximal repeats.

Only suffixes that may have a partner are grouped: a filter of bounded size built from all window hashes of all texts
(see ``sketch``) discards the rest; it never discards a repeated one. Occurrences that meet a partner in their own
Arrow batch are settled there, and a window travels once per batch, however often it occurs: a passage in a third of
all documents is as many rows as there are batches. Positions go back to their text packed, and texts are read
again for the result. Window hashes have 64 bits.

Defined cases: null or empty text has no words and loses none; texts under 35 words lose none; repeated rows are
occurrences of each other, so both lose all their windows; an empty table gives an empty result; extra columns are passed
on, and those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fieldtrace.llm import sketch
from fieldtrace.llm.common import query, row_key
from fieldtrace.llm.words import U64, all_hashes, chunks, inside, windows
from fieldtrace.session import configure

WINDOW, PREFIXES = 35, (8, 16)
#: Suffixes of one group, about.
GROUP = 400_000
ENTRIES = "bucket long, leaf binary, owner binary, position binary"
FLUSH = 1_000_000


def _suffixes(texts: list[bytes | None], window: int):
    """(text, position, hash of the whole window, hashes of the prefixes) of all windows."""
    h, counts = all_hashes(texts)
    valid = inside(counts, window)
    n = len(valid)
    start = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)[:n][valid]
    position = (np.arange(n)[valid] - start[owner]).astype(np.uint32)
    return owner, position, windows(h, window)[valid], [windows(h, k)[:n][valid] for k in PREFIXES]


def _sketch_rows(batches, buckets: int, window: int):
    for batch in batches:
        for _, texts in chunks(batch):
            _, _, leaf, prefix = _suffixes(texts, window)
            values, counts = np.unique(sketch.keys(prefix[0], leaf, buckets), return_counts=True)
            # a window met twice here is sent twice, which is enough to be known as repeated
            yield sketch.pack(np.sort(np.concatenate([values, values[counts > 1]])))


def _groups(bucket: np.ndarray, second: np.ndarray, leaf: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The group of each suffix: of its 8-word prefix; where that has too many, also of the 16-word prefix, and of the whole window."""
    bits = splits[bucket]
    first = np.minimum(bits, 8).astype(U64)
    rest = (np.clip(bits, 8, 20) - 8).astype(U64)
    sixteen = (second >> U64(56)) >> (U64(8) - first)
    whole = (leaf >> U64(52)) >> (U64(12) - rest)
    return (bucket.astype(np.int64) << 20) | (sixteen.astype(np.int64) << 12) | whole.astype(np.int64)


def _runs_of(order_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of equal neighbours."""
    if not len(order_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], order_keys[1:] != order_keys[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(order_keys)]]))


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    offsets = (np.concatenate([starts, [len(values)]]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _by_slot(owner: np.ndarray, position: np.ndarray, slots: int):
    """(slots, starts in the rest, owners, positions): results on their way to their texts, packed by the texts' slots."""
    slot = (owner.view(U64) >> U64(65 - slots.bit_length())).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    at, _ = _runs_of(slot[order])
    return slot[order][at], at, owner[order], position[order]


def _candidates(batches, filter_bytes, bits: int, buckets: int, splits: np.ndarray, window: int):
    """Per group the suffixes that may have a partner; under negative numbers, by slot, (owner, position) of those settled here."""
    for batch in batches:
        for rows, texts in chunks(batch):
            owner, position, leaf, prefix = _suffixes(texts, window)
            key = sketch.keys(prefix[0], leaf, buckets)
            hit = sketch.maybe(filter_bytes.value[0], key, bits)
            owner, position, leaf, second, bucket = owner[hit], position[hit], leaf[hit], prefix[1][hit], (key[hit] >> U64(32)).astype(np.int64)
            who = np.asarray(rows.column("rk"), dtype=np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
            order = np.argsort(leaf, kind="stable")
            starts, lengths = _runs_of(leaf[order])
            if (lengths > 1).any():
                met = order[np.repeat(lengths > 1, lengths)]
                slot, at, whose, where = _by_slot(who[met], position[met], buckets)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - slot), _binaries(np.zeros(0, U64), np.zeros(len(at), np.int64)),
                                                  _binaries(whose, at), _binaries(where, at)], names=["bucket", "leaf", "owner", "position"])
            one = order[starts]
            place = np.where(lengths > 1, np.uint32(0xFFFFFFFF), position[one])  # a settled window only tells the others
            group = _groups(bucket[one], second[one], leaf[one], splits)
            by = np.argsort(group, kind="stable")
            at, _ = _runs_of(group[by])
            yield pa.RecordBatch.from_arrays([pa.array(group[by][at]), _binaries(leaf[one][by], at), _binaries(who[one][by], at), _binaries(place[by], at)],
                                             names=["bucket", "leaf", "owner", "position"])


def _leaves(leaf: np.ndarray, owner: np.ndarray, position: np.ndarray):
    """(owner, position) of the leaves below the deep internal nodes of a group's subtree."""
    order = np.argsort(leaf, kind="stable")
    _, lengths = _runs_of(leaf[order])
    deep = order[np.repeat(lengths > 1, lengths)]
    deep = deep[position[deep] != 0xFFFFFFFF]
    return owner[deep], position[deep]


def _subtrees(batches, slots: int):
    """Group by group (rows come sorted by group): owners and positions of repeated windows, packed by slot."""
    current, parts, found, n = None, [], [], 0

    def close():
        leaf, owner, position = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) for i, t in enumerate((U64, np.int64, np.uint32)))
        return _leaves(leaf, owner, position)

    def flush():
        slot, at, owner, position = _by_slot(*(np.concatenate([x[i] for x in found]) for i in (0, 1)), slots)
        return pa.RecordBatch.from_arrays([pa.array(slot), _binaries(owner, at), _binaries(position, at)], names=["slot", "owner", "position"])

    for batch in batches:
        for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != current and parts:
                found.append(close())
                n += len(found[-1][0])
                parts = []
                if n > FLUSH:
                    yield flush()
                    found, n = [], 0
            current = bucket
            parts.append(row)
    if parts:
        found.append(close())
    if found:
        yield flush()


def _both(batches, slots: int):
    """Settled rows stand first in a partition and pass through; groups follow."""
    batches = iter(batches)
    for batch in batches:
        own = np.asarray(batch.column("bucket")) < 0
        if own.any():
            settled = batch.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(-1 - np.asarray(settled.column("bucket"))), settled.column("owner"), settled.column("position")],
                                             names=["slot", "owner", "position"])
        if not own.all():
            yield from _subtrees(itertools.chain([batch.filter(pa.array(~own))], batches), slots)


def _by_text(table: pa.Table) -> pa.Table:
    """One row for each text of a slot."""
    owner = np.frombuffer(b"".join(table.column("owner").to_pylist()), np.int64)
    position = np.frombuffer(b"".join(table.column("position").to_pylist()), np.uint32)
    order = np.argsort(owner, kind="stable")
    at, _ = _runs_of(owner[order])
    return pa.table({"rk": pa.array(owner[order][at]), "positions": _binaries(position[order], at)})


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(rk, positions): per text with repeated windows, their packed 32-bit start positions, in no order."""
    configure(docs.sparkSession)
    texts = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    buckets, bits = sketch.plan(docs.count())
    seen = sketch.Repeated(texts.select("text").mapInArrow(lambda b: _sketch_rows(b, buckets, window), sketch.PACKED), buckets, bits)
    filter_bytes, per_bucket = seen.filter, seen.bits
    # bits by which a group is split, from the counted occurrences
    splits = np.clip(np.ceil(np.log2(np.maximum(seen.occurrences, 1) / GROUP)), 0, 20).astype(np.int64)
    entries = texts.mapInArrow(lambda b: _candidates(b, filter_bytes, per_bucket, buckets, splits, window), ENTRIES)
    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    packed = dealt.mapInArrow(lambda b: _both(b, buckets), "slot long, owner binary, position binary")
    return packed.groupBy("slot").applyInArrow(lambda t: _by_text(t), "rk long, positions binary")


OUT = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])


def _cut(text: bytes | None, positions: bytes | None, window: int) -> tuple[int, int, bytes]:
    words = text.split() if text else []
    if not positions:
        return len(words), 0, b" ".join(words)
    at = np.frombuffer(positions, np.uint32).astype(np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _cutter(window: int, digest: bool):
    @F.arrow_udf(OUT)
    def cut(text: pa.Array, positions: pa.Array) -> pa.Array:
        rows = [_cut(t, p, window) for t, p in zip(text.cast(pa.binary()).to_pylist(), positions.to_pylist())]
        kept = [hashlib.sha256(r[2]).hexdigest() if digest else r[2].decode("utf-8", "surrogatepass") for r in rows]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])
    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the text without the words of repeated windows (or its SHA-256)."""
    found = repeated_windows(docs, id_col, text_col, window).withColumnsRenamed({"rk": "__rk", "positions": "__positions"})
    joined = docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col))).join(found.hint("shuffle_hash"), "__rk", "left")
    cut = joined.withColumn("__cut", _cutter(window, digest)(F.col(text_col), F.col("__positions")))
    return cut.withColumns({c: F.col(f"__cut.{c}") for c in ("n_words", "n_removed", "kept")}).drop("__rk", "__positions", "__cut")


SQL = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
wins AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM words)),
rep AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM rep),
toks AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
kept AS (SELECT t.doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.i) FILTER (g.i IS NULL), '') AS txt
         FROM toks t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.txt, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op1_substring_dedup", SQL)
def op1_substring_dedup(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
