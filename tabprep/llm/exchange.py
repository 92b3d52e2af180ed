"""Packed exchange of hashed keys between chunks of rows and ranges of the key space.

A task turns a bounded run of rows (a chunk) into sorted keys and sends each
range of the key space one compact row; the range's task sees every chunk's
keys and answers by chunk. A key costs a few bytes in the shuffle, and a chunk
sends each key a bounded number of times, so that a key that fills a third of
the table costs a range one entry per chunk. The number of ranges follows the
input, which bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.words import pack

#: Words of a chunk and entries of a range that a task holds at once, about.
CHUNK_WORDS = 1 << 20
RANGE_ENTRIES = 2 << 20
#: Bits of the fixed-size filter of row keys.
FILTER_BITS = 1 << 23

SCHEMA = "part int, chunk long, a binary, b binary, c binary, d binary"


def ranges_for(docs: DataFrame, text_col: str) -> int:
    """How many ranges the words of all texts need (six bytes a word at least)."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first().n or 0
    return max(1, int(total) // (6 * RANGE_ENTRIES) + 1)


def chunk_name(sequence: int) -> int:
    """The same for a task's chunk whenever the task runs again."""
    return (TaskContext.get().partitionId() << 24) + sequence


def edges(parts: int, bits: int) -> np.ndarray:
    """Where the ranges of keys of ``bits`` bits begin, the first left out."""
    return np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)


def send(chunk: int, keys: np.ndarray, parts: int, bits: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each range: sorted ``keys`` and up to three columns of integers beside them."""
    cuts = [0, *np.searchsorted(keys, edges(parts, bits)).tolist(), len(keys)]
    for part in range(parts):
        lo, hi = cuts[part], cuts[part + 1]
        if lo < hi:
            yield row(part, chunk, pack(keys[lo:hi], True), *[pack(c[lo:hi]) for c in columns])


def row(part: int, chunk: int, *blobs: bytes) -> pa.RecordBatch:
    blobs = (*blobs, *[None] * (4 - len(blobs)))
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]],
        names=["part", "chunk", "a", "b", "c", "d"])


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(sorted_keys)))


def row_filter(rows: DataFrame, *key: str) -> np.ndarray:
    """A bitmap of FILTER_BITS hashed row keys: at most FILTER_BITS / 64 numbers reach the driver, whatever the input."""
    bit = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    words = rows.select((bit / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(key)}), 64) as int))").alias("m"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("m").alias("m")).toLocalIterator():
        out[r.w] = r.m
    return out


def passes(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the xxhash64 values may be in the filter."""
    bit = np.mod(hashed, FILTER_BITS)
    return (bitmap[bit // 64] >> np.mod(hashed, 64)) & 1 == 1
