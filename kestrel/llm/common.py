"""Helpers shared by the operators: Arrow word splitting, hashing, chunking."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def mix64(x):
    """The 64-bit murmur finaliser, elementwise (wraps modulo 2**64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def odd_multipliers(n: int, seed: int):
    """n odd 64-bit multipliers derived from ``seed``."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(_GOLD)) | U64(1)


def hash_strings(values, seed: int = 0):
    """64-bit hashes of a pyarrow string array (equal on every machine)."""
    import pandas as pd
    if len(values) == 0:
        return np.zeros(0, U64)
    raw = pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return mix64(raw ^ U64(seed * _GOLD % (1 << 64)))


def column(batch, name):
    """A column of a batch or table as one contiguous array."""
    col = batch.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def bound_batches(spark, rows: int = 1000, size: str = "4m") -> None:
    """Lowers the session's Arrow batches: rows of text are long, and a
    batch is held several times (both sides of the pipe, off the heap)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release():
    """Hands freed memory back to the system. A Python worker lives through
    many tasks, and what one of them needed at its peak would stay with the
    worker otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):      # not glibc
        pass


def text_chunks(batches, text: str = "text", limit: int = 4 << 20):
    """Record batches cut so that the texts of a cut hold at most ``limit``
    bytes (a longer text stands alone), which bounds a task's memory
    whatever the batch size of the session. No row is left out."""
    release()
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        start = 0
        while start < n:
            base = total[start - 1] if start else 0
            end = max(int(np.searchsorted(total, base + limit, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end
    release()


def split_words(texts, lower: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string array: the flat array of
    words, and offsets (document i owns words offsets[i]:offsets[i+1]).
    Null and blank texts own none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words = parts.flatten()
    off = parts.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        off = np.concatenate([[0], np.cumsum(full)])[off]
        words = words.filter(pa.array(full))
    return words, off


def encode_words(words):
    """Dictionary codes (int64 numpy) and the distinct words."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def planes(x) -> bytes:
    """Integers as byte planes (all low bytes, then the next, ...): the
    high planes are nearly constant and vanish in the shuffle's LZ4."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def unplanes(raw, dtype):
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def bloom_positions(keys, bits: int, n: int = 3):
    """n bit positions per 64-bit key in a filter of 2**bits bits."""
    h = mix64(np.asarray(keys).astype(np.int64).view(U64))
    step = mix64(h ^ U64(_GOLD)) | U64(1)
    return [((h + U64(i) * step) >> U64(64 - bits)).astype(np.int64) for i in range(n)]


def bloom_filter(df, key: str, bits: int = 23):
    """A Bloom filter (packed numpy bits) over a long column. Its size is
    fixed at 2**bits bits, whatever the number of keys; more keys only
    raise the share of false positives, which callers must tolerate."""
    def positions(batches):
        for b in batches:
            keys = column(b, "k").drop_null().to_numpy(zero_copy_only=False)
            pos = np.unique(np.concatenate(bloom_positions(keys, bits))) if len(keys) else np.zeros(0, np.int64)
            word, start = np.unique(pos >> 6, return_index=True)
            if len(word):
                val = np.bitwise_or.reduceat(U64(1) << (pos & 63).astype(U64), start).view(np.int64)
                yield pa.record_batch([pa.array(word), pa.array(val)], names=["w", "v"])

    from pyspark.sql import functions as F
    rows = (df.select(F.col(key).cast("long").alias("k")).mapInArrow(positions, "w long, v long")
            .groupBy("w").agg(F.bit_or("v").alias("v")).toPandas())
    out = np.zeros(1 << (bits - 6), U64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).view(U64)
    return out


def bloom_contains(filt, keys, bits: int = 23):
    hit = np.ones(len(keys), bool)
    for pos in bloom_positions(keys, bits):
        hit &= (filt[pos >> 6] >> (pos & 63).astype(U64)) & U64(1) == 1
    return hit


def ragged_take(starts, lengths):
    """Flat indices starts[i] .. starts[i]+lengths[i]-1 for every i."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def segment_sum(values, offsets):
    """Sums of values[offsets[i]:offsets[i+1]] (empty segments give 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
