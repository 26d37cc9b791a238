"""Words and word-window hashes of texts as NumPy arrays, for functions that run inside Arrow batches.

A word is a run of bytes other than ASCII white space (``bytes.split`` cuts exactly at [\\x20\\x09-\\x0D]). Its hash is
64-bit; windows of words have a polynomial hash over those, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
PRIME = 0x9E3779B97F4A7C15
#: Texts of about so many bytes are worked on at once, whatever the batch size.
CHUNK_BYTES = 6_000_000
#: Words whose hash is remembered; others are hashed again.
MEMO_WORDS = 300_000


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


_memo = _Memo()


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch holding about CHUNK_BYTES of text each, with their texts as bytes."""
    texts = batch.column(column).cast(pa.binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    part = np.cumsum(sizes) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), texts.slice(a, b - a).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), U64, len(words))


def all_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    parts, counts = [np.zeros(0, U64)], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words = (text.lower() if lower else text).split()
            counts[i] = len(words)
            parts.append(word_hashes(words))
    return np.concatenate(parts), counts


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; k - 1 shorter than the input, text borders not yet looked at."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    out, have, block, span = None, 0, hashes, 1
    while k:
        if k & 1:
            if out is None:
                out, have = block, span
            else:
                n = len(hashes) - have - span + 1
                out, have = out[:n] * U64(pow(PRIME, span, 1 << 64)) + block[have:have + n], have + span
        k >>= 1
        if k:
            n = len(block) - span
            block, span = block[:n] * U64(pow(PRIME, span, 1 << 64)) + block[span:], span * 2
    return mix(out)


def inside(counts: np.ndarray, k: int) -> np.ndarray:
    """Which of the positions of ``windows`` start a window that lies in one text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner[:max(0, len(owner) - k + 1)] == owner[k - 1:]
