"""Shared helpers: reading tables, preparing a session, and word arrays over Arrow text buffers.

A word is a maximal run of ``0-9``, ``a-z`` and non-ASCII characters after lower-casing ``A-Z``. In UTF-8 that is a
class of single bytes, so words, their hashes and shingles are found on the raw buffer of an Arrow column at once.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import riskloom
from riskloom.session import materialise, scratch_path

__all__ = ["ROWS_PER_BATCH", "Words", "bounded", "materialise", "prepare", "read", "scratch_path", "slices", "text_array", "without", "word_shingles"]

#: Rows in one Arrow batch sent to Python; whole texts are long, so fewer than Spark's default.
ROWS_PER_BATCH = 1000
#: Text bytes that a task turns into word arrays at once (a longer single text is still taken whole).
SLICE_BYTES = 1 << 20

_M = np.uint64
with np.errstate(over="ignore"):
    _seed = (np.arange(1, 257, dtype=np.uint64) * _M(0x9E3779B97F4A7C15))
    _seed = (_seed ^ (_seed >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    _seed = (_seed ^ (_seed >> _M(27))) * _M(0x94D049BB133111EB)
    BYTE_VALUE = _seed ^ (_seed >> _M(31))
BYTES = np.arange(256)
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
IS_WORD = (((BYTES >= 48) & (BYTES <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (BYTES >= 128)).astype(bool)
LOWER_VALUE = BYTE_VALUE[LOWER]
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task function, which hands freed memory back at its end: workers are kept for later tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return task


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed, and send them small batches."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(riskloom.__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")


def without(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows without columns that results will be named like (names are compared without case, as Spark does)."""
    taken = {n.lower() for n in names}
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c.lower() not in taken))


def text_array(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` text bytes, a single longer text by itself."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


class Words:
    """Word hashes of many texts: ``hashes`` in text order, text ``i`` has ``first[i]:first[i + 1]``."""

    def __init__(self, column: pa.Array):
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        size = len(data)
        inside = IS_WORD[data]
        fresh = np.zeros(size + 1, bool)
        fresh[offsets[:-1]] = True
        fresh[size] = True
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        starts = np.flatnonzero(inside & (fresh[:-1] | ~before[:-1]))
        ends = np.flatnonzero(inside & (fresh[1:] | ~after[1:])) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LOWER_VALUE[data] * _power("up", BASE, size), dtype=np.uint64)])
        back = _power("down", pow(BASE, -1, 1 << 64), size)
        self.hashes = mix((total[ends] - total[starts]) * back[starts]) if len(starts) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(starts, offsets)


SHINGLE_VALUES = [_M(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def word_shingles(words: Words, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words, but not none, has one shingle."""
    n = len(words.hashes)
    if not n:
        return [np.zeros(0, np.uint64) for _ in range(len(words.first) - 1)]
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    end = words.first[1:][text]
    place = np.arange(n)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        at = place + j
        value += np.where(at < end, words.hashes[np.minimum(at, n - 1)] * SHINGLE_VALUES[j], _M(0))
    value = mix(value)
    valid = (place + width <= end) | (place == words.first[:-1][text])
    kept = np.concatenate([[0], np.cumsum(valid)])[words.first]
    value = value[valid]
    return [np.unique(value[a:b]) for a, b in zip(kept[:-1], kept[1:], strict=True)]
