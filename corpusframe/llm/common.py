"""Helpers of the training-data operators: shared folders, words of Arrow text columns, hashes.

Word rule used throughout: a word is a run of bytes outside ``\\x20 \\x09-\\x0D``. UTF-8 continuation
bytes are above 127, so words can be cut on bytes without decoding.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_RE = r"[^\x20\x09-\x0D]+"
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Text handled at once in a task; the largest working arrays are a small multiple of it.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where none is set, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if path is None:
        path = context.getCheckpointDir()
        if path is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="corpusframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that neither Python nor a shuffle runs again.

    A collection on the driver goes before: Spark's cleaner then removes shuffle files that earlier cuts have made needless.
    """
    shared_dir(df.sparkSession)
    df.sparkSession._jvm.System.gc()
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash."""
    return df.select(*[df[n] for n in names])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, UTF-8 bytes, offsets)`` in pieces of about ``limit`` bytes; null is empty text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each text's first word (one more at the end)."""
    n = len(data)
    inside = is_word[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans over 64 bytes go through blake2b."""
    lens = ends - starts
    out = mix(lens.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(lens):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at, left, row = starts, lens, None
    for _ in range(8):
        value = eight[at] & _MASKS[np.minimum(left, 8)]
        if row is None:
            out = mix(out ^ value)
        else:
            out[row] = mix(out[row] ^ value)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        at, left, row = at[more] + 8, left[more] - 8, more if row is None else row[more]
    for k in np.flatnonzero(lens > 64):
        span = data[starts[k] : ends[k]].tobytes()
        out[k] = np.uint64(int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little"))
    return out


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; runs that cross texts are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, seed, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x5851F42D4C957F2D) + words[j : j + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)
