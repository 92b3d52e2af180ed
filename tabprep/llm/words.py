"""Words of an Arrow text column as flat numpy arrays, used inside Spark tasks.

Spark partitions the texts; a task turns a slice of rows into byte positions,
a 64-bit hash per word and a word range per row, without a Python object per
word. Words are told apart by that hash: two different words of a vocabulary of
V words share one with probability below V*V / 2**65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

# Separators of the two word definitions: ASCII white space; everything below
# 0x80 that is neither a digit nor a letter.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARK = np.zeros(256, bool)
MARK[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = {_BASE: np.ones(1, U64), _BASE_INVERSE: np.ones(1, U64)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers[base]) < n:
        p = np.full(max(n, 1 << 20), base, U64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and where each row begins (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (a longer text is a batch of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """Words of every row of ``column``.

    raw: the bytes (lower-cased A-Z if ``fold``); row: where rows begin in raw;
    start, end: byte range of each word; first: index of each row's first word
    (one more at the end); count: words of each row; hash: of each word.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, fold: bool = False, hashed: bool = True):
        raw, self.row = text_buffer(column)
        self.raw = LOWER[raw] if fold else raw
        n = len(raw)
        inside = ~separators[self.raw]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[self.row[:-1][self.row[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[self.row[1:][self.row[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.row)
        self.count = np.diff(self.first)
        if hashed:
            total = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[self.raw] * _power(_BASE, n), out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * _power(_BASE_INVERSE, n + 1)[self.start])

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def whole(self, k: int) -> np.ndarray:
        """Indices of words at which a window of ``k`` words of one row begins."""
        at = np.arange(max(0, len(self.start) - k + 1))
        return at[at + k <= np.repeat(self.first[1:], self.count)[: len(at)]]


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values, at its first index (len(values) - k + 1 of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    block, width, done, out = values, 1, 0, np.zeros(n, U64)
    while done < k:
        if k & width:
            out = out + block[done : done + n] * U64(pow(int(_BASE), done, 1 << 64))
            done += width
        if done < k:
            block = block[:-width] + block[width:] * U64(pow(int(_BASE), width, 1 << 64))
            width *= 2
    return mix(out)


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. (lengths[0] of them), then the same for the next range."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """Integers in as few whole bytes each as the largest (the largest step, if ``ordered``) needs; single bytes, which
    are mostly alike, are compressed too."""
    v = np.asarray(values).astype(U64)
    if ordered and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    head, rest = (v[:1], v[1:]) if ordered else (v[:0], v)
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    low = np.ascontiguousarray(rest).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    if width == 1 and len(low) > 64:
        return bytes([0, ordered]) + head.tobytes() + zlib.compress(low, 1)
    return bytes([width, ordered]) + head.tobytes() + low


def unpack(blob: bytes) -> np.ndarray:
    """What ``pack`` was given, as uint64."""
    width, ordered = blob[0], blob[1]
    at = 2 + 8 * (ordered and len(blob) > 2)
    body = blob[at:]
    if not width:
        width, body = 1, zlib.decompress(body)
    low = np.frombuffer(body, np.uint8).reshape(-1, width)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    out = out.view(U64).ravel()
    if ordered and at > 2:
        return np.cumsum(np.concatenate([np.frombuffer(blob, U64, 1, 2), out]), dtype=U64)
    return out
