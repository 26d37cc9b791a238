"""Which 64-bit hashes occur more than once (and how often, roughly), without moving one row per occurrence.

Map tasks pack their distinct hashes into one sorted binary per bucket (4 bytes each, inside a bucket). A reduce task
sorts a bucket, counts, and answers with a block of a Bloom filter of the repeated hashes. All blocks together have a
fixed number of bits (``sketch_bits``), which is what may be broadcast. The filter errs only towards "repeated", so
it may be used to skip work, never to decide a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from fieldtrace.llm.common import freed_shuffles

U64 = np.uint64
BUCKETS_AT_LEAST, BITS_AT_LEAST, BITS_AT_MOST = 512, 1 << 22, 1 << 29
PACKED = "bucket long, packed binary"
_STEPS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _power(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def plan(rows: int) -> tuple[int, int]:
    """(buckets, bits of the whole filter) for a table of so many texts: buckets of a size that one task holds with
    ease, 512 bits of filter per text up to the fixed most."""
    return (max(BUCKETS_AT_LEAST, _power(rows // 1000)), min(BITS_AT_MOST, max(BITS_AT_LEAST, _power(rows * 512))))


def keys(bucket_of: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (from the top bits of ``bucket_of``) and 32 bits of the hash in one sortable number."""
    top = bucket_of >> U64(65 - buckets.bit_length())
    return (top << U64(32)) | (hashes & U64(0xFFFFFFFF))


def pack(sorted_keys: np.ndarray) -> pa.RecordBatch:
    """One row per bucket of the sorted keys."""
    bucket = (sorted_keys >> U64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0])) if len(bucket) else np.zeros(0, np.int64)
    data = sorted_keys.astype(np.uint32)
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int32) * 4
    blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), blobs], names=["bucket", "packed"])


def _places(low: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint32(32 - (bits.bit_length() - 1))
    return [((low * np.uint32(step)) >> shift).astype(np.int64) for step in _STEPS]


def _block(key, table: pa.Table, bits: int, levels: tuple[int, ...]) -> pa.Table:
    low = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("packed").to_pylist()])
    values, counts = np.unique(low, return_counts=True)
    flags = np.zeros((len(levels), bits), np.uint8)
    for plane, least in zip(flags, levels):
        for place in _places(values[counts >= least], bits):
            plane[place] = 1
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()),
                     "occurrences": pa.array([int(counts[counts > 1].sum())], pa.int64())})


class Repeated:
    """A filter for each level of counts (repeated: 2) and, by bucket, how many occurrences the repeated ones have."""

    def __init__(self, packed: DataFrame, buckets: int, bits: int, levels: tuple[int, ...] = (2,)):
        per_bucket = bits // buckets
        spark = packed.sparkSession
        filter_bytes, self.occurrences = np.zeros((len(levels), bits // 8), np.uint8), np.zeros(buckets, np.int64)
        with freed_shuffles(spark):
            blocks = packed.groupBy("bucket").applyInArrow(lambda key, t: _block(key, t, per_bucket, levels), "bucket long, block binary, occurrences long")
            for row in blocks.collect():  # bits // 8 bytes per level in all, whatever the input
                at = row["bucket"] * per_bucket // 8
                filter_bytes[:, at:at + per_bucket // 8] = np.frombuffer(row["block"], np.uint8).reshape(len(levels), -1)
                self.occurrences[row["bucket"]] = row["occurrences"]
        self.buckets, self.bits = buckets, per_bucket
        self.filter: Broadcast = spark.sparkContext.broadcast(filter_bytes)


def maybe(filter_bytes: np.ndarray, sorted_or_not: np.ndarray, bits: int) -> np.ndarray:
    """Which keys may be repeated; those told False are not. ``bits``: of one bucket."""
    base = (sorted_or_not >> U64(32)).astype(np.int64) * bits
    low = sorted_or_not.astype(np.uint32)
    hit = np.ones(len(low), bool)
    for place in _places(low, bits):
        at = base + place
        hit &= (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit
