"""Exact substring deduplication with fixed-block anchors (operator 9).

A window of ``window`` words that occurs in two documents holds, in the first,
one whole reference block: blocks are non-overlapping runs of window // 2 words
from the start of a text. So:

1. Anchors. Every text's reference blocks are indexed by hash, and every
   rolling run of a block's length probes the index, in ranges of the hash
   space. A hash that two documents share, one of them at a reference block, is
   an anchor in all of them.
2. Extension. The windows around anchors are compared by their own hash; each
   finds the smallest document that holds it. Runs of such windows are the
   maximal repeats, and their words go from all documents but the smallest.

Windows are judged on the input, not on what is left. Words and windows are
told apart by 64-bit hashes. Documents that share nothing are finished in the
scan; a fixed-size filter of row keys tells them from the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.llm.exchange import CHUNK_WORDS, SCHEMA, chunk_name, groups, passes, ranges_for, row, row_filter, send
from tabprep.llm.words import Words, covered, pack, ragged, rolling, slices, unpack
from tabprep.session import cut_lineage

_OUT = "id long, digest long, text string, n_words long, n_removed long, kept_sha256 string"


class _Chunk:
    """Words of a run of texts: hash of each, and a row's id, digest, first word and word count."""

    def __init__(self, kept: list):
        self.ids = np.concatenate([k[0] for k in kept])
        self.digests = np.concatenate([k[1] for k in kept])
        self.count = np.concatenate([k[2] for k in kept])
        self.hash = np.concatenate([k[3] for k in kept])
        self.wanted = np.concatenate([k[4] for k in kept])
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.rank = np.unique(self.ids, return_inverse=True)[1]

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def table(self, parts: int, chunk: int, places: np.ndarray) -> pa.RecordBatch:
        """The row that names the chunk's rows, and the places that it settled by itself."""
        return row(-1 - chunk % parts, chunk, self.ids.tobytes(), self.digests.tobytes(), pack(self.count), pack(np.sort(places), True))


def _chunks(batches: Iterator[pa.RecordBatch], window: int, wanted: Callable) -> Iterator[_Chunk]:
    """Runs of texts of about CHUNK_WORDS words; texts without a whole window are left out."""
    kept, size = [], 0
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        long = words.count >= window
        here = np.repeat(long, words.count)
        kept.append((batch.column("id").to_numpy(zero_copy_only=False)[long], batch.column("digest").to_numpy(zero_copy_only=False)[long],
                     words.count[long], words.hash[here], wanted(batch, words)[here]))
        size += int(here.sum())
        if size >= CHUNK_WORDS:
            yield _Chunk(kept)
            kept, size = [], 0
    if size:
        yield _Chunk(kept)


def _within(words: Words, length: int) -> np.ndarray:
    """Whether ``length`` words of the same text begin at each word."""
    out = np.zeros(len(words.start), bool)
    out[words.whole(length)] = True
    return out


def _find_anchors(batches: Iterator[pa.RecordBatch], window: int, block: int, parts: int) -> Iterator[pa.RecordBatch]:
    for sequence, c in enumerate(_chunks(batches, window, lambda _, words: _within(words, block))):
        place = np.flatnonzero(c.wanted)
        keys = rolling(c.hash, block)[place] >> np.uint64(8)
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], place[order]
        owner = c.row_of(place)
        indexed = (place - c.first[owner]) % block == 0
        at, n = groups(keys)
        shared = np.minimum.reduceat(c.rank[owner], at) != np.maximum.reduceat(c.rank[owner], at)
        known = np.repeat(shared, n)  # shared inside the chunk: anchors already, sent once without a place
        code = np.where(known, np.repeat(np.logical_or.reduceat(indexed, at), n), 2 * (place + 1) + indexed)
        first = np.zeros(len(keys), bool)
        first[at] = True
        sent = ~known | first
        chunk = chunk_name(sequence)
        yield c.table(parts, chunk, place[known])
        yield from send(chunk, keys[sent], parts, 56, code[sent])


def _match_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a range's keys: places of those that two chunks hold, one of them at a reference block."""
    if rows.part[0] < 0:
        return rows[["chunk", "a", "b", "c", "d"]]
    keys = [unpack(x) for x in rows.a]
    chunk = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
    code, keys = np.concatenate([unpack(x) for x in rows.b]).astype(np.int64), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    code, chunk = code[order], chunk[order]
    at, n = groups(keys[order])
    hit = (chunk[at] != chunk[at + n - 1]) & np.logical_or.reduceat(code & 1 == 1, at)
    return _answer(rows, chunk, code // 2 - 1, np.repeat(hit, n) & (code >= 2))


def _answer(rows: pd.DataFrame, chunk: np.ndarray, place: np.ndarray, told: np.ndarray) -> pd.DataFrame:
    chunk, place = chunk[told], place[told]
    order = np.lexsort((place, chunk))
    chunk, place = chunk[order], place[order]
    at, n = groups(chunk)
    return pd.DataFrame({"chunk": rows.chunk.to_numpy()[chunk[at]], "a": None, "b": None, "c": None,
                         "d": [pack(place[i : i + k], True) for i, k in zip(at, n, strict=True)]})


def _find_windows(batches: Iterator[pa.RecordBatch], window: int, block: int, parts: int) -> Iterator[pa.RecordBatch]:
    def wanted(batch: pa.RecordBatch, words: Words) -> np.ndarray:
        places = [unpack(blob).astype(np.int64) for blob in batch.column("places").to_pylist()]
        begin = np.repeat(words.first[:-1], [len(p) for p in places])
        p = begin + np.concatenate(places)
        lo = np.maximum(p - (window - block), begin)
        return covered(lo, p - lo + 1, len(words.start)) & _within(words, window)

    for sequence, c in enumerate(_chunks(batches, window, wanted)):
        place = np.flatnonzero(c.wanted)
        keys = rolling(c.hash, window)[place]
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], place[order]
        owner = c.row_of(place)
        at, n = groups(keys)
        later = c.rank[owner] > np.repeat(np.minimum.reduceat(c.rank[owner], at), n) if len(at) else np.zeros(0, bool)
        chunk = chunk_name(sequence)
        yield c.table(parts, chunk, place[later])
        yield from send(chunk, keys[~later], parts, 64, place[~later], c.ids[owner[~later]] - np.iinfo(np.int64).min)


def _match_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a range's windows: places of those that a document with a smaller id holds."""
    if rows.part[0] < 0:
        return rows[["chunk", "a", "b", "c", "d"]]
    keys = [unpack(x) for x in rows.a]
    chunk = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
    keys = np.concatenate(keys)
    place, ids = (np.concatenate([unpack(x) for x in column]) for column in (rows.b, rows.c))
    order = np.argsort(keys, kind="stable")
    at, n = groups(keys[order])
    told = ids[order] > np.repeat(np.minimum.reduceat(ids[order], at), n)
    return _answer(rows, chunk[order], place[order].astype(np.int64), told)


def _by_row(rows: pd.DataFrame) -> pd.DataFrame:
    """A chunk's places (its own and those of the answers) by row, from the row's first word."""
    table = rows[rows.a.notna()].iloc[0]
    ids, digests = np.frombuffer(table.a, np.int64), np.frombuffer(table.b, np.int64)
    first = np.concatenate([[0], np.cumsum(unpack(table.c).astype(np.int64))])
    place = np.unique(np.concatenate([unpack(x) for x in rows.d]).astype(np.int64))
    owner = np.searchsorted(first, place, "right") - 1
    at, n = groups(owner)
    return pd.DataFrame({"id": ids[owner[at]], "digest": digests[owner[at]],
                         "places": [pack(place[i : i + k] - first[owner[i]], True) for i, k in zip(at, n, strict=True)]})


def _exchange(rows: DataFrame, find: Callable, match: Callable) -> DataFrame:
    answers = rows.mapInArrow(find, SCHEMA).groupBy("part").applyInPandas(match, "chunk long, a binary, b binary, c binary, d binary")
    found = answers.groupBy("chunk").applyInPandas(_by_row, "id long, digest long, places binary")
    return cut_lineage(found.groupBy("id", "digest").agg(F.max("places").alias("places")))


def _strip(column: pa.Array, places: list, window: int) -> tuple[list, list, list, list]:
    """Each text without the words of its windows; word counts; digest of the kept words."""
    words = Words(column, hashed=False)
    found = [(at, unpack(blob).astype(np.int64)) for at, blob in zip(words.first[:-1].tolist(), places, strict=True) if blob is not None]
    gone = covered(np.concatenate([at + p for at, p in found]), window, len(words.start)) if found else np.zeros(len(words.start), bool)
    raw, texts, removed, shas = words.raw.tobytes(), [], [], []
    original = column.to_pylist()
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        own = gone[a:b]
        lost = int(own.sum())
        if lost:
            edge = np.flatnonzero(np.diff(np.concatenate([[1], own.astype(np.int8), [1]])))
            start = np.append(words.start[a:b], words.row[i + 1])
            pieces = [raw[start[x] : start[y]] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            text = b"".join(pieces).rstrip(b" \t\n\r\x0b\x0c")
        else:
            text = raw[words.row[i] : words.row[i + 1]]
        texts.append(text.decode() if lost else original[i])
        removed.append(lost)
        shas.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
    return texts, words.count.tolist(), removed, shas


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, digest (xxhash64 of the text), text without the words of every window that a
    document with a smaller id holds, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A text that loses nothing stays as it is; where words go, the white space after them goes too. Null texts stay null
    and count no words; texts of fewer than ``window`` words stay whole. Rows with the same id count as one document:
    none of them is smaller than another. A null id is in no order, so such rows neither lose nor take words. Other
    columns are not read, but for ``keep``, which comes along as ``kept``; an empty table gives an empty result.
    """
    block = window // 2
    also = [F.col(keep).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *also).withColumn("digest", F.xxhash64("text"))
    parts = ranges_for(rows, "text")
    texts = rows.where("id is not null and text is not null").drop("kept")
    anchors = _exchange(texts, lambda b: _find_anchors(b, window, block, parts), _match_anchors)
    near = _only(texts, row_filter(anchors, "id", "digest"), True)
    repeats = _exchange(near.join(anchors, ["id", "digest"]), lambda b: _find_windows(b, window, block, parts), _match_windows)
    bitmap = row_filter(repeats, "id", "digest")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            places = batch.column("places").to_pylist() if "places" in batch.schema.names else [None] * batch.num_rows
            done = _strip(batch.column("text"), places, window)
            arrays = [batch.column("id"), batch.column("digest"), *map(pa.array, done, (pa.string(), pa.int64(), pa.int64(), pa.string()))]
            arrays += [batch.column("kept")] if keep else []
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    out = T.StructType([*T.StructType.fromDDL(_OUT).fields, *(f for f in rows.schema.fields if f.name == "kept")])
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    untouched = _keyed(rows).mapInArrow(lambda batches: finish(_passing(batches, shared.value, False)), out)  # the filter and the rest in one task
    changed = _only(rows, bitmap, True).join(repeats, ["id", "digest"], "left").mapInArrow(finish, out)
    return untouched.unionByName(changed)


def _only(rows: DataFrame, bitmap: np.ndarray, inside: bool) -> DataFrame:
    """Rows that may be (or, if not ``inside``, surely aren't) in the filter."""
    shared, keyed = rows.sparkSession.sparkContext.broadcast(bitmap), _keyed(rows)
    return keyed.mapInArrow(lambda batches: _passing(batches, shared.value, inside), keyed.schema).drop("key")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("id", "digest"))


def _passing(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("key").to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(passes(bitmap, ids) == inside))
